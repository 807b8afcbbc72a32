"""How many weighted places lie within reach of each place, and the least id among them, without listing pairs.

Places of one name are cut into square tiles; a tile's task also gets the places just across its border. Inside, places are ranked by
latitude and by longitude, a place's reach is a rectangle of ranks, and a merge tree over the latitude ranks counts all
rectangles level by level: n log^2 n steps for n places, however many are within reach of one another. A tile with more
places than a task should hold is dealt into chunks, and every chunk of askers meets every chunk of places, as counts add up.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of a chunk, about, and rows that a task counts at a time.
CHUNK = 1 << 16
#: Sides of a tile, in reaches.
TILE = 64


def bounds(values: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Per asker the range [a, b) of ranks whose values are less than `reach` away, in a group's sorted values[first:last].

    By the subtraction that an exact test would make; it rises with the values, so it can be searched for.
    """

    def search(inside) -> np.ndarray:
        lo, hi = first.copy(), last.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            right = open_ & ~inside(values[np.minimum(mid, len(values) - 1)])
            lo, hi = np.where(right, mid + 1, lo), np.where(open_ & ~right, mid, hi)
        return lo

    return search(lambda v: at - v < reach), search(lambda v: v - at >= reach)


def least_of(table: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of each non-empty range, by two overlapping ranges of a power of two."""
    k = np.frexp((b - a).astype(float))[1] - 1
    out = np.empty(len(a), np.int64)
    for level in np.unique(k):
        m = k == level
        out[m] = np.minimum(table[level][a[m]], table[level][b[m] - (1 << level)])
    return out


def rectangles(column: np.ndarray, weight: np.ndarray, ident: np.ndarray, r1, r2, c1, c2) -> tuple[np.ndarray, np.ndarray]:
    """Sum of weights and least id of the points in each rectangle. Point i stands in row i and column[i]."""
    n, many = len(column), len(r1)
    total, least = np.zeros(many, np.int64), np.full(many, np.iinfo(np.int64).max)
    lo, hi = r1.copy(), r2.copy()
    level = 0
    while (lo < hi).any():
        # the points of each block of 2**level rows, by column
        key = (np.arange(n) >> level) * n + column
        order = np.argsort(key, kind="stable")
        key = key[order]
        sums = np.concatenate([[0], np.cumsum(weight[order])])
        table = [ident[order]]
        for k in range(level):
            prev = table[-1]
            table.append(np.minimum(prev[: len(prev) - (1 << k)], prev[1 << k :]) if len(prev) > 1 << k else prev[:0])
        for take, block in ((lo, True), (hi, False)):
            odd = np.flatnonzero((lo < hi) & (take & 1 == 1))
            at = lo[odd] if block else hi[odd] - 1
            a, b = np.searchsorted(key, at * n + c1[odd]), np.searchsorted(key, at * n + c2[odd])
            total[odd] += sums[b] - sums[a]
            some = np.flatnonzero(b > a)
            if len(some):
                least[odd[some]] = np.minimum(least[odd[some]], least_of(table, a[some], b[some]))
            if block:
                lo[odd] += 1
            else:
                hi[odd] -= 1
        lo, hi, level = lo >> 1, hi >> 1, level + 1
    return total, least


def counted(group: np.ndarray, asks: np.ndarray, lat: np.ndarray, lon: np.ndarray, n: np.ndarray, ident: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """(sum of n, least id) within reach for each asking row, over the rows of its group that do not ask."""
    p = np.flatnonzero(~asks)
    q = np.flatnonzero(asks)
    by_lat = p[np.lexsort((lon[p], lat[p], group[p]))]
    by_lon = p[np.lexsort((lat[p], lon[p], group[p]))]
    first, last = np.searchsorted(group[by_lat], group[q], "left"), np.searchsorted(group[by_lat], group[q], "right")
    r1, r2 = bounds(lat[by_lat], first, last, lat[q], reach)
    c1, c2 = bounds(lon[by_lon], first, last, lon[q], reach)
    column = np.empty(len(lat), np.int64)
    column[by_lon] = np.arange(len(p))
    return rectangles(column[by_lat], n[by_lat], ident[by_lat], r1, np.maximum(r1, r2), c1, c2)


def counting(cell: list[str], reach: float):
    """For mapInPandas over rows sorted by their cell: counts whole cells, as many at a time as make up a chunk."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        group = rows["_group"].to_numpy()
        asks = rows["_asks"].to_numpy(bool)
        total, least = counted(group, asks, *(rows[c].to_numpy() for c in ("lat", "lon", "n", "least")), reach)
        out = rows.loc[asks].drop(columns=["_group", "_asks", "n", "least", "_ask", "_met", "_ty", "_tx"])
        return out.assign(reach=total, least=least)[lambda d: d["reach"] > 0]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting = None
        for part in parts:
            rows = part if waiting is None else pd.concat([waiting, part], ignore_index=True)
            new = reduce(lambda a, b: a | b, (rows[c].ne(rows[c].shift()) for c in cell)).to_numpy()
            rows["_group"] = np.cumsum(new)
            # the last cell may go on in the next part
            begin = int(np.flatnonzero(new)[-1])
            if begin >= CHUNK or (begin and len(rows) >= 2 * CHUNK):
                yield count(rows.iloc[:begin].reset_index(drop=True))
                waiting = rows.iloc[begin:].drop(columns="_group").reset_index(drop=True)
            else:
                waiting = rows.drop(columns="_group")
        if waiting is not None and len(waiting):
            new = reduce(lambda a, b: a | b, (waiting[c].ne(waiting[c].shift()) for c in cell)).to_numpy()
            yield count(waiting.assign(_group=np.cumsum(new)).reset_index(drop=True))

    return run


def within_reach(places: DataFrame, keys: list[str], reach: float, chunk: int = CHUNK) -> DataFrame:
    """(keys, lat, lon, reach, least): of the places (keys, lat, lon, n, least), each position once per key, the sum of n and the least `least`
    of those whose latitude and longitude both differ by less than `reach`, itself included. Keys, lat and lon are not null.
    """
    side = reach * TILE
    tile = lambda c, shift=0.0: F.floor((F.col(c) + shift) / side).cast("bigint")
    # a place is met in its own tile and in those whose border it is near to
    near = lambda c: F.array_distinct(F.array(tile(c, -1.01 * reach), tile(c), tile(c, 1.01 * reach)))
    own = places.withColumns({"_ty": tile("lat"), "_tx": tile("lon")})
    met = places.withColumn("_ty", F.explode(near("lat"))).withColumn("_tx", F.explode(near("lon")))
    at = [*keys, "_ty", "_tx"]
    chunks = met.groupBy(*at).agg(F.ceil(F.count("*") / chunk).cast("int").alias("_chunks")).filter("_chunks > 1")
    part: Column = F.pmod(F.xxhash64("lat", "lon"), F.col("_chunks")).cast("int")
    every: Column = F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))
    cut = lambda df: df.join(chunks, at, "left").withColumn("_chunks", F.coalesce("_chunks", F.lit(1)))
    asking = cut(own).withColumns({"_ask": part, "_met": every}).withColumn("_asks", F.lit(True)).drop("_chunks")
    points = cut(met).withColumns({"_ask": every, "_met": part}).withColumn("_asks", F.lit(False)).drop("_chunks")
    cell = [*at, "_ask", "_met"]
    rows = asking.unionByName(points).repartition(*(F.col(c) for c in cell)).sortWithinPartitions(*cell)
    kinds = ", ".join(f"{k} {places.schema[k].dataType.simpleString()}" for k in keys)
    out = rows.select(*cell, "_asks", "lat", "lon", F.col("n").cast("bigint").alias("n"), F.col("least").cast("bigint").alias("least")).mapInPandas(
        counting(cell, reach), f"{kinds}, lat double, lon double, reach bigint, least bigint")
    return out.groupBy(*keys, "lat", "lon").agg(F.sum("reach").alias("reach"), F.min("least").alias("least"))
