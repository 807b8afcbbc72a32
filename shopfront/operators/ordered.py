"""Ordered computations per key that do not put a whole key into one task.

A window over a hot key sorts that key in a single task. These helpers cut each key
into buckets that follow the order (a day, an hour, a block of ids), work inside the
buckets, and carry only one small row per bucket across them.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def bucketed(df: DataFrame, keys: list[str], order: list[Column], bucket: Column | None) -> DataFrame:
    """Adds _bucket, which rises with the order within each key.

    Without a given one the rows are dealt into ranges of (keys, order) between sampled splitters, about equally many rows in each,
    so that a key with most of the rows, even with all of them in one hour, is cut into many. The dealt rows are
    written, as a second sample would cut elsewhere.
    """
    if bucket is not None:
        return df.withColumn("_bucket", bucket)
    # a given number, so that adaptive execution does not put ranges together again
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, *(F.col(k) for k in keys), *order).withColumn("_bucket", F.spark_partition_id())
    return Workspace(df.sparkSession, "ranges").written(dealt, "rows")


def numbered(df: DataFrame, keys: list[str], order: list[Column], bucket: Column | None, out: str) -> DataFrame:
    """Adds the 1-based position of each row within its key. `bucket` must rise with the order; None takes sampled ranges."""
    df = bucketed(df, keys, order, bucket)
    sizes = df.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    local = df.withColumn("_local", F.row_number().over(inside))
    joined = local.join(starts, _same(local, starts, [*keys, "_bucket"]), "left")
    return joined.select(*(local[c] for c in local.columns if not c.startswith("_")),
                         (F.col("_before") + F.col("_local")).cast("bigint").alias(out))


def previous(df: DataFrame, keys: list[str], order: list[Column], value: str, bucket: Column | None, out: str) -> DataFrame:
    """Adds the value of the row before in the same key, NULL on the first row of the key."""
    df = bucketed(df, keys, order, bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    local = df.withColumns({"_prev": F.lag(value).over(inside), "_local": F.row_number().over(inside)})
    last = df.groupBy(*keys, "_bucket").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carried = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket"))).drop("_last")
    joined = local.join(carried, _same(local, carried, [*keys, "_bucket"]), "left")
    return joined.select(*(local[c] for c in local.columns if not c.startswith("_")),
                         F.when(F.col("_local") > 1, F.col("_prev")).otherwise(F.col("_carry")).alias(out))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One whole row per key: the first in the given order. Partial aggregation before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*df.columns)


def insert_new(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """existing plus the first incoming row of every key not yet there (INSERT OR IGNORE)."""
    unseen = incoming.join(existing.select(*keys).distinct(), keys, "left_anti")
    return existing.unionByName(first_per_key(unseen, keys, order))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The n first rows of every key. Spark cuts each input partition to n rows per key before the shuffle."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rn") <= n).drop("_rn")


def left_join_known(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Left join by a key that is NULL in many rows. Those meet nothing, so they stay where they are instead of going to one task."""
    more = [f for f in other.schema.fields if f.name != key]
    known = df.filter(F.col(key).isNotNull()).join(other, key, "left")
    loose = df.filter(F.col(key).isNull()).select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in more))
    return known.unionByName(loose)
