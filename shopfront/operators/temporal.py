"""Joins in time: the value held at a moment, events that fall into intervals, and how many do.

Both sides of a question are put in one order per key and dealt into ranges between sampled splitters. Work stays inside a range;
one small row per key and range carries the last value, or the count, into the ranges after it. So a key may hold any share of the rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrays import keep, unnest
from .ordered import _same, bucketed

#: Levels of time cells; a cell of the top level is 2 ** LEVELS base cells.
LEVELS = 24


def _carried(local: DataFrame, per_bucket: DataFrame, keys: list[str]) -> DataFrame:
    return local.join(per_bucket, _same(local, per_bucket, [*keys, "_bucket"]), "left").select(*(local[c] for c in local.columns), per_bucket["_carry"])


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, values: list[str], tie: str, strict: bool = False) -> DataFrame:
    """Left rows with the values of the last right row of the same keys at or before them (before them, if strict); NULL where there is none.

    Of right rows at one time the one with the greatest `tie` counts. Rows whose keys or time are NULL meet nothing. Columns of both
    sides may have any names; a value that the left side has too is given as `<name>_then`.
    """
    side = lambda df, n, at, own: df.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col(at).alias("_at"), F.lit(n).alias("_side"), *own)
    l_row, r_row = F.struct(*left.columns), F.struct(F.col(tie).alias("_tie"), *(F.col(v).alias(f"_v{i}") for i, v in enumerate(values)))
    r_type = right.select(r_row.alias("r")).schema["r"].dataType
    l_type = left.select(l_row.alias("l")).schema["l"].dataType
    known = F.col(right_at).isNotNull()
    # a right row at the same time comes before the left row, or after it where it must not count
    rights = side(right.filter(known), 2 if strict else 0, right_at, [F.lit(None).cast(l_type).alias("_l"), r_row.alias("_r")])
    lefts = side(left, 1, left_at, [l_row.alias("_l"), F.lit(None).cast(r_type).alias("_r")])
    names = [f"_k{i}" for i in range(len(keys))]
    order = [F.col("_at"), F.col("_side"), F.col("_r._tie")]
    rows = bucketed(rights.unionByName(lefts), names, order, None)
    inside = Window.partitionBy(*names, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_held", F.last("_r", ignorenulls=True).over(inside))
    last = rows.filter("_r IS NOT NULL").groupBy(*names, "_bucket").agg(F.max_by("_r", F.struct("_at", "_r._tie")).alias("_last"))
    # every range of a key, also those without a right row
    every = rows.select(*names, "_bucket").distinct()
    spread = every.join(last, _same(every, last, [*names, "_bucket"]), "left").select(*(every[c] for c in every.columns), "_last")
    before = Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = spread.withColumn("_carry", F.last("_last", ignorenulls=True).over(before)).drop("_last")
    joined = _carried(local, carry, names).filter("_side = 1")
    meets = F.col("_at").isNotNull()
    for n in names:
        meets = meets & F.col(n).isNotNull()
    held = F.when(meets, F.coalesce("_held", "_carry"))
    out = joined.withColumn("_then", held)
    new = [v + "_then" if v in left.columns else v for v in values]
    return out.select(*(F.col("_l").getField(c).alias(c) for c in left.columns), *(F.col("_then").getField(f"_v{i}").alias(n) for i, n in enumerate(new)))


def count_during(intervals: DataFrame, events: DataFrame, keys: list[str], ident: str, start: str, end: str, at: str) -> DataFrame:
    """(ident, n): how many events of the same keys have start <= at < end. No pairs are made: both ends are placed among the events
    and the counts before them subtracted. A NULL end is open; a NULL start or key meets nothing. ident is unique.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    named = [F.col(k).alias(n) for k, n in zip(keys, names)]
    usable = F.col(at).isNotNull()
    ticks = events.filter(usable).select(*named, F.col(at).alias("_at"), F.lit(1).alias("_n"), F.lit(None).cast(intervals.schema[ident].dataType).alias("_id"), F.lit(0).alias("_sign"))
    ends = F.explode(F.array(F.struct(F.col(start).alias("t"), F.lit(-1).alias("s")), F.struct(F.col(end).alias("t"), F.lit(1).alias("s"))))
    # an open end lies after all events; an interval that ends before it starts holds nothing
    usable = F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start)))
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    far = F.lit("9999-12-31 00:00:00").cast("timestamp")
    marks = intervals.filter(usable).select(*named, F.col(ident).alias("_id"), ends.alias("_e")).select(
        *names, F.when(F.col("_e.s") > 0, F.coalesce("_e.t", far)).otherwise(F.col("_e.t")).alias("_at"), F.lit(0).alias("_n"), "_id", F.col("_e.s").alias("_sign"))
    order = [F.col("_at"), F.col("_n")]  # a mark goes before the events of its time
    rows = bucketed(ticks.unionByName(marks), names, order, None)
    inside = Window.partitionBy(*names, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_before", F.sum("_n").over(inside))
    sizes = rows.groupBy(*names, "_bucket").agg(F.sum("_n").alias("_size"))
    before = Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.withColumn("_carry", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    counted = _carried(local, carry, names).filter("_id IS NOT NULL")
    found = counted.groupBy(F.col("_id").alias(ident)).agg(F.sum(F.col("_sign") * (F.col("_before") + F.col("_carry"))).alias("n"))
    return intervals.select(ident).join(found, ident, "left").select(ident, F.coalesce("n", F.lit(0)).alias("n"))


def time_cells(first: Column, last: Column) -> Column:
    """The fewest cells (level, cell) that cover the base cells first..last: at most two of each level.

    Of the cells of a level that lie inside, the first goes if it is the right half of its parent and the last if it is a left half; the others are
    inside a cell of the next level. Levels above the interval's length are not looked at. `first` and `last` are written out in every level's
    terms, so they should be columns that are there, not computed ones.
    """
    begin, end = first.cast("bigint"), last.cast("bigint") + 1
    shift = lambda c, level: F.call_function("shiftright", c, level)
    odd = lambda c: c.bitwiseAND(1) == 1
    cell = lambda level, at: F.struct(level.alias("level"), at.alias("cell"))
    none = F.array().cast("array<struct<level:int,cell:bigint>>")

    def of_level(level):
        low, high = -shift(-begin, level), shift(end, level)  # the whole cells inside: from low up to, not with, high
        at_begin, at_end = (low < high) & odd(low), (low < high) & odd(high) & ((low + 1 < high) | ~odd(low))
        ends = F.concat(F.when(at_begin, F.array(cell(level, low))).otherwise(none), F.when(at_end, F.array(cell(level, high - 1))).otherwise(none))
        rest = F.when(low < high, F.transform(F.sequence(low, F.greatest(low, high - 1)), lambda c: cell(level, c))).otherwise(none)
        return F.when(level < LEVELS, ends).otherwise(rest)

    highest = F.least(F.lit(LEVELS), F.length(F.bin(F.greatest(end - begin, F.lit(0).cast("bigint"))))).cast("int")
    return F.flatten(F.transform(F.sequence(F.lit(0), highest), of_level))


def during(intervals: DataFrame, events: DataFrame, keys: list[str], start: str, end: str, at: str, cell_seconds: int = 3600) -> DataFrame:
    """All pairs of an interval and an event of the same keys with start <= at < end, columns of both sides; their names must not clash.

    An interval is cut to a few cells of doubling length, an event is in one cell of each level, and each pair meets in just one cell:
    an equi join, however long an interval is. A NULL end is open; NULL starts, times and keys meet nothing.

    Both sides are dealt by the hash of key and cell: Spark takes the rows of an explode for as few as those before it, and would
    send all cells of all events through the driver to every executor.
    """
    base = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / (cell_seconds * 1_000_000)).cast("bigint")
    last = events.agg(F.max(at).alias("_last")).first()[0]  # one value
    if last is None:
        return intervals.join(events.drop(*keys).limit(0), F.lit(True), "inner").limit(0)
    horizon = F.lit(last).cast("timestamp") + F.expr("INTERVAL 1 SECOND")
    until = F.least(F.coalesce(F.col(end), horizon), horizon)
    open_ = intervals.withColumn("_until", until).filter((F.col(start) < F.col("_until")))
    # through an array of one entry, so that the cells work on columns that are there
    cut = keep(open_, F.lit(True), [*open_.columns, base(F.col(start)).alias("_first"), base(F.col("_until")).alias("_last")])
    cut = unnest(cut, [*open_.columns], time_cells(F.col("_first"), F.col("_last")), "_c")
    cut = cut.withColumns({"_level": F.col("_c.level"), "_cell": F.col("_c.cell")}).drop("_c")
    # an event is only placed on levels that some interval uses: at most LEVELS + 1 numbers
    used = [r[0] for r in cut.select("_level").distinct().orderBy("_level").collect()]
    levels = F.transform(F.array(*(F.lit(n) for n in used or [0])), lambda k: F.named_struct(F.lit("level"), k, F.lit("cell"), F.call_function("shiftright", base(F.col(at)), k)))
    placed = events.filter(F.col(at).isNotNull()).withColumn("_c", F.explode(levels)).withColumns({"_level": F.col("_c.level"), "_cell": F.col("_c.cell")}).drop("_c")
    met = cut.hint("merge").join(placed.hint("merge"), [*keys, "_level", "_cell"]).filter((F.col(start) <= F.col(at)) & (F.col(at) < F.col("_until")))
    return met.drop("_level", "_cell", "_until")
