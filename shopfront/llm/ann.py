"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. Vectors are dealt into blocks; each block posts its vectors in
inverted files, one per pivot, with the pivot's rank. A block of queries meets a block of vectors as one row of a join,
the query set against all rows in blocks. There the files of a query's pivots are gone through, footrule distances follow from the ranks the two
orders share, the nearest orders are candidates, and inner products in double precision on the original vectors rank them. The best of all blocks are merged.
As many as some square roots of the rows are reranked per query; on vectors without clusters fewer do not reach a recall of 0.9, nor do the cells of a
query's nearest pivots, so a query's order is held against all orders.

Largest inner product is turned into nearness by one more component, sqrt(M**2 - |x|**2) with M the largest norm; 0 for queries.
Vectors that are equal are one entry of a block, with its smallest ids. Recall against brute force is measured in the tests and stated in the README.

Defined results. Vectors null, empty, zero, of another length than most, or with null or non-finite components take no part; neither do
rows without an id. Of rows that share an id one counts, that with the smallest vector. Ties go to the smaller id. No rows: no rows.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Pivots, a bounded sample of the vectors, and how many of them an order names.
PIVOTS = 256
NAMED = 64
#: Vectors in a block, and queries in a block of queries.
BLOCK = 2048
QUERY_BLOCK = 512
#: Blocks of queries that are kept in mind together, and groups that the blocks of vectors are dealt into.
GROUPED = 16
VECTOR_GROUPS = 24
#: Of n vectors RERANKED * sqrt(n) are reranked for a query, and of a block that share of its entries, LEAST at least.
RERANKED = 14
LEAST = 32

PACKED = "block bigint, ids binary, vectors binary, ranks binary"


def taking_part(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) of the vectors that count."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).filter("id IS NOT NULL").filter(F.coalesce(finite, F.lit(False)))
    length = rows.groupBy(F.size("v").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").first()
    rows = rows.filter(F.size("v") == (length.length if length else 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def ranks_of(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray, named: int) -> np.ndarray:
    """Rank of each pivot for each row (named and beyond: not among the nearest). pivots hold the further component."""
    order = np.argsort(-(x @ pivots[:, :-1].T + extra[:, None] * pivots[:, -1]), axis=1, kind="stable")[:, :named]
    out = np.full((len(x), len(pivots)), named, np.uint8)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.uint8)[None, :], axis=1)
    return out


def packed(rows: DataFrame, size: int, pivots: np.ndarray, top: float, named: int, queries: bool) -> DataFrame:
    """Rows (id, v) as blocks of up to `size`: ids, vectors as doubles, ranks."""

    def pack(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            x = np.array(batch.column("v").flatten()).reshape(len(ids), -1)
            for lo in range(0, len(ids), size):
                order = lo + np.argsort(ids[lo : lo + size], kind="stable")
                part = x[order]
                extra = np.zeros(len(part)) if queries else np.sqrt(np.maximum(0, top * top - (part * part).sum(1)))
                ranks = ranks_of(part, extra, pivots, named)
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[order[0]])]), pa.array([ids[order].tobytes()]), pa.array([part.tobytes()]), pa.array([ranks.tobytes()])], ["block", "ids", "vectors", "ranks"])

    return rows.mapInArrow(pack, PACKED)


class InvertedFiles:
    """The entries of a block posted under their pivots. Equal vectors are one entry with its smallest ids."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, ranks: np.ndarray, named: int, results: int):
        _, first, entry = np.unique(x, axis=0, return_index=True, return_inverse=True)
        self.x, self.named, ranks = x[first], named, ranks[first]
        order = np.argsort(entry.reshape(-1), kind="stable")  # ids ascend within an entry
        begins = np.searchsorted(entry.reshape(-1)[order], np.arange(len(first) + 1))
        self.ids = [ids[order[a : min(b, a + results + 1)]] for a, b in zip(begins[:-1], begins[1:])]
        # one file per pivot, of a number per entry: how far its rank is from `named`; zero where the order does not name the pivot
        self.files = np.ascontiguousarray((named - ranks.astype(np.int16)).T)

    def search(self, query: np.ndarray, ranks: np.ndarray, own: int, results: int, share: float, least: int) -> list[tuple[int, float]]:
        # footrule over orders cut at `named` is a constant less 2 * (named - larger rank) for each pivot both name
        mine = np.flatnonzero(ranks < self.named)
        near = np.minimum(self.files[mine], (self.named - ranks[mine].astype(np.int16))[:, None]).sum(axis=0, dtype=np.int16)
        count = min(len(near), max(least, int(share * len(near))))
        chosen = np.argpartition(-near, count - 1)[:count]
        # summed row by row in one order, so that equal vectors score alike in every block
        score = np.add.reduce(self.x[chosen] * query, axis=1)
        # of equal scores all, as ids decide between them
        cut = np.sort(score)[-(results + 1)] if len(score) > results else -np.inf
        found = [(int(i), float(s)) for e, s in zip(chosen[score >= cut], score[score >= cut]) for i in self.ids[e] if i != own]
        return sorted(found, key=lambda f: (-f[1], f[0]))[:results]


def search(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, results: int = 20,
           pivots: int = PIVOTS, named: int = NAMED, block: int = BLOCK, query_block: int = QUERY_BLOCK, reranked: float = RERANKED, least: int = LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, its nearest other rows."""
    rows = written(taking_part(vectors, id_col, vector_col), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    top, many = rows.agg(F.max(norm), F.count("*")).first()
    top, share = top or 0.0, min(1.0, reranked / max(1, many) ** 0.5)
    drawn = rows.select("v", F.xxhash64("id").alias("order")).orderBy("order").limit(4 * pivots).collect()
    p = np.unique(np.array([r.v for r in drawn]), axis=0) if drawn else np.zeros((0, 1))
    p = np.random.default_rng(8).permutation(p)[:pivots]
    p = np.concatenate([p, np.sqrt(np.maximum(0, top * top - (p * p).sum(1)))[:, None]], axis=1)
    named = min(named, max(1, len(p)))
    data = written(packed(rows, block, p, top, named, False), "vector-blocks")
    asked = written(packed(rows.filter(F.pmod("id", F.lit(every)) == 0), query_block, p, top, named, True), "query-blocks")
    # every block of queries meets every block of vectors, in cells of a group of each; a cell keeps the best of its queries
    query_groups = max(1, -(-asked.count() // GROUPED))
    group = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select(*[F.col(c).alias(f"q_{c}") for c in ("block", "ids", "vectors", "ranks")], F.pmod(F.xxhash64("block"), F.lit(query_groups)).cast("int").alias("query_group"), group(VECTOR_GROUPS).alias("vector_group"))
    right = data.select("block", "ids", "vectors", "ranks", F.pmod(F.xxhash64("block"), F.lit(VECTOR_GROUPS)).cast("int").alias("vector_group"), group(query_groups).alias("query_group"))
    # as many tasks as cells; a given number, so that adaptive execution does not put cells together
    cells = query_groups * VECTOR_GROUPS
    cell = ["query_group", "vector_group"]
    pairs = left.repartition(cells, *cell).join(right.repartition(cells, *cell), cell)

    def compare(batches):
        last, files = None, None
        best: dict[int, list[tuple[int, float]]] = {}
        for batch in batches:
            for b, ids, x, ranks, q_ids, q_x, q_ranks in zip(*(batch.column(c) for c in ("block", "ids", "vectors", "ranks", "q_ids", "q_vectors", "q_ranks"))):
                n = np.frombuffer(ids.as_py(), np.int64)
                if last != b.as_py():
                    files = InvertedFiles(n, np.frombuffer(x.as_py()).reshape(len(n), -1), np.frombuffer(ranks.as_py(), np.uint8).reshape(len(n), -1), named, results)
                    last = b.as_py()
                q = np.frombuffer(q_ids.as_py(), np.int64)
                q_vectors, q_r = np.frombuffer(q_x.as_py()).reshape(len(q), -1), np.frombuffer(q_ranks.as_py(), np.uint8).reshape(len(q), -1)
                for i, own in enumerate(q.tolist()):
                    found = files.search(q_vectors[i], q_r[i], own, results, share, least)
                    best[own] = sorted([*best.get(own, ()), *found], key=lambda f: (-f[1], f[0]))[:results]
        rows = [(own, *f) for own, found in best.items() for f in found]
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in rows], pa.int64()), pa.array([f[1] for f in rows], pa.int64()), pa.array([f[2] for f in rows], pa.float64())], ["query_id", "vec_id", "score"])

    found = pairs.select("block", "ids", "vectors", "ranks", "q_ids", "q_vectors", "q_ranks").mapInArrow(compare, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= results).select("query_id", "rank", "vec_id", "score")
