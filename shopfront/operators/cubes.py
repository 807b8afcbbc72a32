"""Distinct counts over several groupings in one pass, by sketches that merge upwards, beside the exact counts."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Registers of a sketch are 2 ** PRECISION; the standard error of an estimate is about 1.04 / sqrt of that, 0.8 %.
PRECISION = 14
ERROR = 1.04 / 2 ** (PRECISION / 2)
LEVELS = {"day": ["day"], "week": ["week"], "month": ["month"], "category": ["category"], "month_category": ["month", "category"], "total": []}


def activity_cube(activity: DataFrame, key: str = "business_id") -> DataFrame:
    """(level, day, week, month, category, n, estimate, exact) of activity rows (day, category, key).

    The rows are reduced once to one row per day, category and key. From these come a sketch and a count per day and category, which
    merge to every level without the rows; and the exact distinct counts, for which Spark expands the reduced rows by level.
    A key or a day that holds most of the rows is reduced before anything is shuffled. Rows without a key count in n only.
    """
    reduced = activity.groupBy("day", "category", key).agg(F.count("*").alias("n")).withColumns(
        {"week": F.to_date(F.date_trunc("week", "day")), "month": F.to_date(F.date_trunc("month", "day"))})
    base = reduced.groupBy("day", "week", "month", "category").agg(F.sum("n").alias("n"), F.hll_sketch_agg(key, F.lit(PRECISION)).alias("sketch"))
    columns = ["day", "week", "month", "category"]
    levels = [[F.col(c) for c in cs] for cs in LEVELS.values()]
    every = [F.col(c) for c in columns]
    which = F.grouping_id(*every).alias("_level")
    merged = base.groupingSets(levels, *every).agg(which, F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    exact = reduced.groupingSets(levels, *every).agg(which, F.count_distinct(key).alias("exact"))
    on = merged["_level"] == exact["_level"]
    for c in columns:
        on = on & merged[c].eqNullSafe(exact[c])
    # bit i of the grouping id, from the left, is set where a column is rolled up
    number = {sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in cs): name for name, cs in LEVELS.items()}
    name = F.create_map(*(x for k, v in number.items() for x in (F.lit(k).cast("bigint"), F.lit(v))))
    return merged.join(exact, on).select(name[merged["_level"].cast("bigint")].alias("level"), *(merged[c] for c in columns), "n", "estimate", "exact")
