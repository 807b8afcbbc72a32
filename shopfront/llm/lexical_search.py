"""Ranked lexical search turned around: the items are indexed, the documents go by.

The terms of the items are posted in an inverted index that is broadcast, a block of items at a time. A first pass over the
documents writes each one's length and its counts of indexed terms; these give the number of documents N, of all terms L,
and of documents per term, hence the weights. A second pass streams the counts through the index: each document's terms
add their worth to the items that hold them, and per item a heap keeps the best `most` documents of the task. Heaps are
merged per item, in two steps. Texts are read once per block of items, and one block is the rule.

A score is the sum, over the item's distinct terms, of w * ((10**9 * tf) div (1000 * tf + 8 * m)), with
w = floor(1000 * ln((2N + 2) / (2 df + 1))) and m = 10 + ((90 * n * N) div L); all in 64-bit integers, or in Python's
where these would not hold. Terms are found by hash and then compared byte by byte.

Defined results. Null or empty texts have no terms: such documents do not count in N, such items find nothing. Items
of one id, also of none, are one item with the terms of all its rows. Repeated documents, also without an id, are ranked
each on its own. Equal scores go by ascending id, a null id last. An item that finds fewer than `most` documents gives
fewer rows. No items or no documents: no rows. Other columns play no part. Document ids are integers.
"""
from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, lean, removed, written
from .word_runs import word_slices
from .words import WORD, words_of

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (item, term) pairs of a block of items: what the driver gathers and a worker holds at a time. An item is in one block.
BLOCK_PAIRS = 1 << 18
#: Bytes of text whose words a task holds at a time.
SLICE_BYTES = 1 << 20
#: Scores that a task holds at a time, and postings it adds up at a time.
CELLS = 1 << 20
#: Parts into which the heaps of an item are merged first.
MERGES = 64
LARGEST = (1 << 62) - 1


@dataclass
class Index:
    """Terms by ascending hash; `holders[first[t]:first[t + 1]]` are the items of term t, as positions in `items`."""

    items: list
    hashes: np.ndarray
    text: np.ndarray
    at: np.ndarray
    first: np.ndarray
    holders: np.ndarray

    def find(self, words) -> tuple[np.ndarray, np.ndarray]:
        """(places in words, terms) of the words that are terms of the index."""
        if not len(self.hashes) or not len(words.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        t = np.minimum(np.searchsorted(self.hashes, words.hashes), len(self.hashes) - 1)
        size = words.end - words.start
        place = np.flatnonzero((self.hashes[t] == words.hashes) & (size == (self.at[1:] - self.at[:-1])[t]))
        t, size = t[place], size[place]
        if not len(place):
            return place, t
        # every byte of every found word against the term's
        begin = np.cumsum(size) - size
        inside = np.arange(size.sum()) - np.repeat(begin, size)
        same = words.data[np.repeat(words.start[place], size) + inside] == self.text[np.repeat(self.at[t], size) + inside]
        right = np.logical_and.reduceat(same, begin)
        return place[right], t[right]


def index_of(pairs: list[tuple]) -> Index:
    """pairs: (item, term), each once. Two terms of one hash, which nobody has seen, are refused rather than mixed up."""
    items = sorted({i for i, _ in pairs}, key=lambda i: (i is None, i))
    place = {item: k for k, item in enumerate(items)}
    terms = sorted({t for _, t in pairs})
    raw = [t.encode() for t in terms]
    text = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    words = words_of(text, np.array([0, len(text)], np.int64), WORD)
    order = np.argsort(words.hashes, kind="stable")
    if len(order) != len(terms) or (len(order) and (np.diff(words.hashes[order]) == 0).any()):
        raise ValueError("two terms have one hash")
    number = {terms[o]: k for k, o in enumerate(order.tolist())}
    posted = np.array(sorted((number[t], place[i]) for i, t in pairs), np.int64).reshape(-1, 2)
    sizes = (words.end - words.start)[order]
    spelt = np.frombuffer(b"".join(raw[o] for o in order.tolist()), np.uint8)
    return Index(items, words.hashes[order], spelt, np.concatenate([[0], np.cumsum(sizes)]), np.searchsorted(posted[:, 0], np.arange(len(order) + 1)), posted[:, 1])


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, term), each once."""
    found = F.regexp_extract_all(F.translate(F.col(text_col).cast("string"), UPPER, LOWER), F.lit(TERM), F.lit(0))
    return items.select(F.col(item_col).alias("item"), F.explode(F.array_distinct(found)).alias("term")).distinct()


def counted(index, text_slot: int = 1):
    """For mapInArrow: (id, text) to (id, n, terms, tfs) of the documents that have a term."""

    def lists(values, ends, kind):
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values, kind))

    def count(batches):
        held = index.value
        width = max(1, len(held.hashes))
        for batch in batches:
            waiting = None  # a long text that came in several slices
            for lo, hi, data, offsets in word_slices(batch.column(text_slot), WORD, SLICE_BYTES):
                words = words_of(data, offsets, WORD)
                n = np.diff(words.first)
                place, term = held.find(words)
                row = np.searchsorted(words.first, place, side="right") - 1
                key, tf = np.unique(row * width + term, return_counts=True)
                if waiting is not None and waiting[0] != lo:
                    yield out(batch, *waiting, width, lists)
                    waiting = None
                if hi - lo > 1:
                    yield out(batch, lo, hi, n, key, tf, width, lists)
                elif waiting is None:
                    waiting = (lo, hi, n, key, tf)
                else:
                    both, slot = np.unique(np.concatenate([waiting[3], key]), return_inverse=True)
                    sums = np.bincount(slot, np.concatenate([waiting[4], tf]), len(both)).astype(np.int64)
                    waiting = (lo, hi, waiting[2] + n, both, sums)
            if waiting is not None:
                yield out(batch, *waiting, width, lists)

    def out(batch, lo, hi, n, key, tf, width, lists):
        row = key // width
        ends = np.searchsorted(row, np.arange(hi - lo), side="right")
        made = pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), lists(key % width, ends, pa.int32()), lists(tf, ends, pa.int64())], ["id", "n", "terms", "tfs"])
        return made.filter(pa.array(n > 0))

    return count


def worth(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """(10**9 * tf) div (1000 * tf + 8 * m)."""
    if len(tf) and (int(tf.max()) > LARGEST // 10**9 or int(m.max()) > LARGEST // 16):
        return np.array([10**9 * a // (1000 * a + 8 * b) for a, b in zip(tf.tolist(), m.tolist())], np.int64)
    return 10**9 * tf // (1000 * tf + 8 * m)


def lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of documents of n terms."""
    if len(n) and 90 * int(n.max()) * documents > LARGEST:
        return np.array([10 + 90 * k * documents // total for k in n.tolist()], np.int64)
    return 10 + 90 * n.astype(np.int64) * documents // max(1, total)


def ranked(index, weights, documents: int, total: int, most: int, item_type: pa.DataType):
    """For mapInArrow: counts to the best documents per item of this task, (item, id, score)."""

    def push(heap, entry):
        if len(heap) < most:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)

    def rank(batches):
        held, weight = index.value, weights.value
        n_items = len(held.items)
        heaps: list[list] = [[] for _ in range(n_items)]
        least = np.ones(n_items, np.int64)  # a score below this cannot enter the heap
        many = np.diff(held.first)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            m = lengths(np.asarray(batch.column(1)), documents, total)
            ends = np.concatenate([[0], np.cumsum(np.asarray(batch.column(2).value_lengths()))])
            terms, tfs = (np.asarray(batch.column(c).flatten()) for c in (2, 3))
            doc = np.repeat(np.arange(len(ids)), np.diff(ends))
            value = weight[terms] * worth(tfs, m[doc])
            posted = np.concatenate([[0], np.cumsum(many[terms])])
            lo = 0
            while lo < len(ids):
                # documents whose scores and postings fit, one at least
                hi = min(lo + max(1, CELLS // max(1, n_items)), int(np.searchsorted(posted[ends], posted[ends[lo]] + CELLS, side="right")) - 1)
                hi = min(max(hi, lo + 1), len(ids))
                a, b = ends[lo], ends[hi]
                size = many[terms[a:b]]
                inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                item = held.holders[np.repeat(held.first[terms[a:b]], size) + inside]
                score = np.zeros((hi - lo) * n_items, np.int64)
                np.add.at(score, np.repeat((doc[a:b] - lo) * n_items, size) + item, np.repeat(value[a:b], size))
                score = score.reshape(hi - lo, n_items)
                for d, i in zip(*(x.tolist() for x in np.nonzero(score >= least))):
                    one = ids[lo + d]
                    # of equal scores the smaller id is better, and a null id the worst
                    push(heaps[i], (int(score[d, i]), one is not None, -(one or 0)))
                    if len(heaps[i]) == most:
                        least[i] = max(1, heaps[i][0][0])
                lo = hi
        rows = [(i, *entry) for i, heap in enumerate(heaps) for entry in heap]
        yield pa.RecordBatch.from_arrays([pa.array([held.items[r[0]] for r in rows], item_type), pa.array([-r[3] if r[2] else None for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["item", "id", "score"])

    return rank


def best(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    order = Window.partitionBy("item", *keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def search_block(rows: DataFrame, pairs: list[tuple], kind: str, most: int) -> DataFrame:
    """The best documents of a block of items, as a written table."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    spark = rows.sparkSession
    index = index_of(pairs)
    shared = spark.sparkContext.broadcast(index)
    path = fresh_path(spark, "term-counts")
    counts = written(rows.mapInArrow(lean(counted(shared)), "id bigint, n bigint, terms array<int>, tfs array<bigint>"), "term-counts", path)
    documents, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    # as many rows as the block has terms
    df = {r.term: r.n for r in counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    weights = spark.sparkContext.broadcast(np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(index.hashes))], np.int64))
    item_type = to_arrow_type(_parse_datatype_string(kind))
    heaps = counts.mapInArrow(lean(ranked(shared, weights, documents, total, most, item_type)), f"item {kind}, id bigint, score bigint")
    merged = best(best(heaps.withColumn("part", F.spark_partition_id() % MERGES), most, "part"), most)
    out = written(merged.select("item", "rank", "id", "score"), "ranked")
    shared.destroy()
    weights.destroy()
    removed(spark, path)
    return out


def search(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", most: int = 10, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Per item its best documents: item, rank, document and score. Written before it is returned."""
    kind = items.schema[item_col].dataType.simpleString()
    path = fresh_path(docs.sparkSession, "item-terms")
    pairs = written(item_terms(items, item_col, text_col), "item-terms", path)
    blocks = max(1, math.ceil(pairs.count() / block_pairs))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))
    out = None
    for b in range(blocks):
        found = search_block(rows, [tuple(r) for r in pairs.filter(block == b).collect()], kind, most)
        out = found if out is None else out.unionByName(found)
    removed(docs.sparkSession, path)
    return out.select(F.col("item").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def oracle_sql() -> str:
    """The same rows in DuckDB's SQL, over `documents` and `benchmark`."""
    words = lambda text: f"regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '{TERM}')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {words("text")} AS terms FROM documents WHERE text IS NOT NULL),
n AS (SELECT row, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
every AS (SELECT count(*) AS docs, sum(n) AS l FROM n),
item AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({words("text")}) AS term FROM benchmark WHERE text IS NOT NULL)),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM item) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, every GROUP BY term, docs),
v AS (SELECT row, n.doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // l))) AS v FROM tf JOIN w USING (term) JOIN n USING (row), every),
s AS (SELECT item_id, doc_id, CAST(sum(v) AS BIGINT) AS score FROM item JOIN v USING (term) GROUP BY item_id, row, doc_id HAVING sum(v) > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s) WHERE rank <= 10"""
