"""Arrays to rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, keep: list, array: Column, alias: str) -> DataFrame:
    """One row per entry of a computed array.

    A plain explode makes the optimizer add `size(array) > 0` below it, which computes an
    expensive array (parsed JSON, regex matches over a page) a second time. The outer form
    does not, and the NULL row of an empty array is dropped right after.
    """
    return df.select(*keep, F.explode_outer(array).alias(alias)).filter(F.col(alias).isNotNull())


def unnest_with_position(df: DataFrame, keep: list, array: Column, pos: str, alias: str) -> DataFrame:
    """The same with the 0-based position of each entry."""
    pairs = F.transform(array, lambda v, i: F.struct(i.alias("i"), v.alias("v")))
    rows = unnest(df, keep, pairs, "_pair")
    names = [c for c in rows.columns if c != "_pair"]
    return rows.select(*names, F.col("_pair.i").alias(pos), F.col("_pair.v").alias(alias))


def keep(df: DataFrame, condition: Column, columns: list) -> DataFrame:
    """The given columns of rows that meet a condition on deeply computed columns.

    A plain filter would be pushed below the projections that compute those columns, and with
    each one the nested expressions would be written out again in full. Going through a
    one-entry array keeps the condition where its columns already are.
    """
    return unnest(df, [], F.when(condition, F.array(F.struct(*columns))), "_row").select("_row.*")
