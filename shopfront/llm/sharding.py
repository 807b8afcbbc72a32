"""Shards of nearly equal bytes by sampled splitters.

Records are ordered by (60 bits of the text's md5, id), so equal texts lie side by side. Keys are sampled with
weight by size: the records with the smallest -ln(u)/size, u being a hash of the record. Their quantiles are
the splitters of the ranges. Ranges that came out overfull, such as a large group of equal texts, are sampled and
split again on the second part of the key. Each range is small, so a window inside it gives exact running
sums; the shard is where the middle of the record falls in the whole, and the slot its number in the shard.

The splitters are the only thing gathered on the driver: `SAMPLE` keys at most at a time, whatever the
input. The table of ranges is as long as the number of ranges and is joined, not collected.

Defined results. Null text has size 1 and the crc32 of no bytes; a null id sorts first. Rows that repeat in
every way lie in one range, in any order among themselves. No rows: no rows. Law: `bytes`; shard loads differ from the
mean by one record's size at most.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Keys drawn for splitters, the bound of what the driver gathers.
SAMPLE = 16384
#: Bytes of text aimed at in a range, and the ranges there are at least.
RANGE_BYTES = 32 << 20
RANGES = 64
#: A range with more than so many times the mean is split again.
OVERFULL = 2.0
#: Rounds of splitting at most; what is still overfull then is rows equal in both key parts.
ROUNDS = 3


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint").alias("k1"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(1 << 63))).alias("k2"),
    )


def splitters(rows: DataFrame, pieces: int, sample: int = SAMPLE) -> list[tuple[int, int]]:
    """Up to pieces - 1 keys that part the rows into ranges of nearly equal bytes."""
    u = (F.pmod(F.xxhash64("k1", "k2", "size"), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    drawn = rows.select("k1", "k2", (-F.log(u) / F.col("size")).alias("order")).orderBy("order", "k1", "k2").limit(min(sample, 32 * pieces)).collect()
    keys = sorted((r.k1, r.k2) for r in drawn)
    return sorted({keys[len(keys) * i // pieces] for i in range(1, pieces)}) if keys else []


def range_number(bounds: list[tuple[int, int]]):
    """A column function: how many splitters are at or below the key."""
    first = np.array([b[0] for b in bounds], np.int64)
    second = np.array([b[1] for b in bounds], np.int64)

    @F.pandas_udf("int")
    def number(k1: pd.Series, k2: pd.Series) -> pd.Series:
        a = k1.to_numpy()
        lo, hi = np.searchsorted(first, a, "left"), np.searchsorted(first, a, "right")
        for i in np.flatnonzero(hi > lo):
            hi[i] = lo[i] + np.searchsorted(second[lo[i] : hi[i]], k2.iat[i], "right")
        return pd.Series(hi.astype(np.int32))

    return number("k1", "k2")


def ranged(rows: DataFrame, sample: int = SAMPLE, range_bytes: int = RANGE_BYTES, least: int = RANGES) -> tuple[DataFrame, DataFrame]:
    """Rows with the number of their range `r`, in key order, and the ranges with their rows and bytes."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    pieces = min(sample // 8, max(least, -(-total // range_bytes)))
    bounds = splitters(rows, pieces, sample)
    for _ in range(ROUNDS):
        placed = rows.withColumn("r", range_number(bounds))
        ranges = placed.groupBy("r").agg(F.sum("size").alias("range_bytes"), F.count("*").alias("range_rows"))
        full = {x.r: x.range_bytes for x in ranges.filter(F.col("range_bytes") > OVERFULL * total / pieces).collect()}
        if not full:
            break
        inside = placed.filter(F.col("r").isin(list(full)))
        share = min(sample // 8, max(2, round(2 * sum(full.values()) * pieces / total)))
        more = sorted({*bounds, *splitters(inside, share, sample)})
        if more == bounds:
            break
        bounds = more
    placed = rows.withColumn("r", range_number(bounds))
    return placed, placed.groupBy("r").agg(F.sum("size").alias("range_bytes"), F.count("*").alias("range_rows"))


def assign(docs: DataFrame, shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard (from 0), slot (from 0, gapless in a shard), grown_shard (null)."""
    rows = written(keyed(docs, id_col, text_col), "shard-keys")
    placed, ranges = ranged(rows, **how)
    # as many rows as ranges: a small table, whose running sums one task can take
    order = Window.orderBy("r")
    ranges = ranges.select("r", F.sum("range_bytes").over(order).alias("until"), F.sum("range_bytes").over(Window.partitionBy()).alias("total"), "range_bytes")
    inside = Window.partitionBy("r").orderBy("k1", "k2")
    upto = F.col("until") - F.col("range_bytes") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    middle = 2 * upto - F.col("size")
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * F.col("total")))).cast("int")
    dealt = written(placed.join(F.broadcast(ranges), "r").select("id", "size", "crc", "r", "k1", "k2", shard.alias("shard")), "shard-rows")
    counts = dealt.groupBy("r", "shard").agg(F.count("*").alias("n"))
    counts = counts.select("r", "shard", (F.sum("n").over(Window.partitionBy("shard").orderBy("r")) - F.col("n")).alias("earlier"))
    inside = Window.partitionBy("r", "shard").orderBy("k1", "k2")
    slot = (F.col("earlier") + F.row_number().over(inside) - 1).cast("bigint")
    return dealt.join(F.broadcast(counts), ["r", "shard"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
