"""Benchmark decontamination with an index per training shard.

A shard is a slice of documents inside a task. Words that no benchmark phrase holds cannot be part of an
occurrence, so the index is built over the stretches of benchmark words that are long enough for the
shortest phrase; this loses nothing. Each phrase is searched backwards through wavelet ranks, occurrences
are located by sampled positions, and their spans are merged per document.

The benchmark is the query set: it goes to the tasks in blocks of bounded size, one pass over the row per
block, all inside the scan of the documents. Documents are never shuffled.

Defined results. Null or empty text: no words, not contaminated. A null or empty item holds no phrase. A null
item_id is not listed (its phrase still hits). Rows that repeat are answered each on its own. Any other
column is left alone; results are only the columns named here.
"""
from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, text_slices
from .fm_index import FmIndex
from .words import WORD, words_of

#: Benchmark text in one block, the bound of what is broadcast at once.
BLOCK_BYTES = 8 << 20
#: Document text in one shard.
SHARD_BYTES = 4 << 20

FOUND = "spans array<struct<first:bigint,last:bigint>>, items array<bigint>"


@dataclass
class Phrases:
    """The distinct windows of a block of benchmark items, over the block's own vocabulary."""

    size: int
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    words: list[bytes] = field(default_factory=list)
    patterns: np.ndarray = field(default_factory=lambda: np.zeros((0, 1), np.int64))
    lengths: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    items: list[list[int]] = field(default_factory=list)

    @staticmethod
    def of(rows: list[tuple[int | None, str | None]], size: int) -> "Phrases":
        table: dict[tuple[bytes, ...], set] = defaultdict(set)
        for item, text in rows:
            data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
            w = words_of(data, np.array([0, len(data)]), WORD)
            words = [w.data[a:b].tobytes() for a, b in zip(w.start, w.end)]
            for i in range(max(1, len(words) - size + 1) if words else 0):
                table[tuple(words[i : i + size])].update(() if item is None else (item,))
        if not table:
            return Phrases(size)
        known = sorted({w for phrase in table for w in phrase})
        data = np.frombuffer(b" ".join(known), np.uint8)
        hashes = words_of(data, np.array([0, len(data)]), WORD).hashes
        order = np.argsort(hashes, kind="stable")
        known = [known[i] for i in order]
        # symbols 0 and 1 end the shard and part its stretches
        number = {w: i + 2 for i, w in enumerate(known)}
        patterns = np.zeros((len(table), max(map(len, table))), np.int64)
        for i, phrase in enumerate(table):
            patterns[i, : len(phrase)] = [number[w] for w in phrase]
        return Phrases(size, hashes[order], known, patterns, np.array([len(p) for p in table]), [sorted(v) for v in table.values()])


def occurrences(w, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(number of the first word in the slice, phrase) of every occurrence."""
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(phrases.hashes) or not len(w.hashes):
        return nothing
    at = np.searchsorted(phrases.hashes, w.hashes)
    at[at == len(phrases.hashes)] = 0
    known = phrases.hashes[at] == w.hashes
    # stretches of known words inside a document, as half-open word ranges
    edge = np.zeros(len(known) + 1, np.int8)
    edge[w.first] = 1
    before = np.concatenate([[False], known[:-1]]) & (edge[:-1] == 0)
    after = np.concatenate([known[1:], [False]]) & (edge[1:] == 0)
    begin, end = np.flatnonzero(known & ~before), np.flatnonzero(known & ~after) + 1
    long_enough = end - begin >= phrases.lengths.min()
    begin, end = begin[long_enough], end[long_enough]
    if not len(begin):
        return nothing
    length = end - begin
    base = np.repeat(begin - np.concatenate([[0], np.cumsum(length[:-1] + 1)]), length + 1)
    position = np.arange(len(base)) + base  # the word each symbol stands for; one more per stretch for its end
    parted = np.zeros(len(base), bool)
    parted[np.cumsum(length + 1) - 1] = True
    inside = np.flatnonzero(~parted)
    symbol = np.ones(len(base) + 1, np.int64)
    symbol[-1] = 0
    for i, word in zip(inside.tolist(), position[inside].tolist()):
        k = int(at[word])
        if w.data[w.start[word] : w.end[word]].tobytes() == phrases.words[k]:  # not just the same hash
            symbol[i] = k + 2
    index = FmIndex(symbol, len(phrases.words) + 2)
    lo, hi = index.search(phrases.patterns, phrases.lengths)
    count = hi - lo
    which = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(which))
    return position[index.locate(rows)], which


def search_slice(data: np.ndarray, offsets: np.ndarray, phrases: Phrases):
    """Per row of the slice: words, merged spans of hit words (numbers in the row, end exclusive), item ids; and the words themselves."""
    w = words_of(data, offsets, WORD)
    first, which = occurrences(w, phrases)
    rows = len(offsets) - 1
    row = np.searchsorted(w.first, first, side="right") - 1
    cover = np.zeros(len(w.hashes) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + phrases.lengths[which], -1)
    hit = np.cumsum(cover)[:-1] > 0 if len(first) else np.zeros(len(w.hashes), bool)
    spans: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
    items: list[set[int]] = [set() for _ in range(rows)]
    for r, p in set(zip(row.tolist(), which.tolist())):
        items[r].update(phrases.items[p])
    for r in np.unique(row).tolist():
        a, b = w.first[r], w.first[r + 1]
        change = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]])))
        spans[r] = list(zip(change[::2].tolist(), change[1::2].tolist()))
    return w, spans, items


def benchmark_blocks(benchmark: DataFrame, size: int, item_col: str, text_col: str, block_bytes: int) -> Iterator[Phrases]:
    """The benchmark's phrases, a bounded block at a time; blocks are dealt by a hash of the row."""
    rows = benchmark.select(F.col(item_col).cast("bigint").alias("item"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    for i in range(blocks):
        phrases = Phrases.of([tuple(r) for r in rows.filter(block == i).toLocalIterator()], size)
        if len(phrases.items) or i == 0:
            yield phrases


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find(docs: DataFrame, benchmark: DataFrame, *, size: int = 10, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per document: id, n_words, spans (words hit, from 0, end exclusive, merged) and items (sorted ids)."""
    kind = docs.schema[id_col].dataType.simpleString()
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(0).cast("bigint").alias("n_words"), F.expr("array()").cast("array<struct<first:bigint,last:bigint>>").alias("spans"), F.expr("array()").cast("array<bigint>").alias("items"))
    found_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    for phrases in benchmark_blocks(benchmark, size, item_col, item_text_col, block_bytes):
        shared = df.sparkSession.sparkContext.broadcast(phrases)

        def block_pass(batches, shared=shared):
            for batch in batches:
                got_spans, got_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
                counts, spans, items = [], [], []
                for lo, hi, data, offsets in text_slices(batch.column("text"), shard_bytes):
                    w, new_spans, new_items = search_slice(data, offsets, shared.value)
                    counts += np.diff(w.first).tolist()
                    for r in range(hi - lo):
                        pairs = merged(new_spans[r] + [(s["first"], s["last"]) for s in got_spans[lo + r] or ()])
                        spans.append([{"first": a, "last": b} for a, b in pairs])
                        items.append(sorted(new_items[r] | set(got_items[lo + r] or ())))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), pa.array(counts, pa.int64()), pa.array(spans, found_type), pa.array(items, pa.list_(pa.int64()))], ["id", "text", "n_words", "spans", "items"])

        df = df.mapInArrow(lean(block_pass), f"id {kind}, text string, n_words bigint, {FOUND}")
    return df.select(F.col("id").alias(id_col), "n_words", "spans", "items")


def cut(text: str, phrases: Phrases) -> str:
    """The text without hit spans; again where the cut brings a new occurrence together."""
    while True:
        data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        w, spans, _ = search_slice(data, np.array([0, len(data)]), phrases)
        if not spans[0]:
            return text
        raw, out, at = data.tobytes(), [], 0
        for a, b in spans[0]:
            out.append(raw[at : w.start[a]])
            at = int(w.end[b - 1])
        text = b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def remove(docs: DataFrame, benchmark: DataFrame, *, size: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
           block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The documents, all columns, with hit spans cut from the text; a document of which no word is left by the cut goes.

    With several benchmark blocks, a cut for one block may join words into a phrase of an earlier one; so the
    blocks are gone through once more, and what the second round finds is cut as well.
    """
    schema = docs.schema
    out = docs
    blocks = [docs.sparkSession.sparkContext.broadcast(p) for p in benchmark_blocks(benchmark, size, item_col, item_text_col, block_bytes)]
    for shared in blocks * (2 if len(blocks) > 1 else 1):

        def block_pass(batches, shared=shared):
            at = schema.fieldNames().index(text_col)
            for batch in batches:
                texts, keep = batch.column(at).to_pylist(), np.ones(batch.num_rows, bool)
                changed = False
                for lo, hi, data, offsets in text_slices(batch.column(at), shard_bytes):
                    _, spans, _ = search_slice(data, offsets, shared.value)
                    for r in (r for r in range(hi - lo) if spans[r]):
                        texts[lo + r] = cut(texts[lo + r], shared.value)
                        left = np.frombuffer(texts[lo + r].encode("utf-8", "surrogatepass"), np.uint8)
                        keep[lo + r] = len(words_of(left, np.array([0, len(left)]), WORD).hashes) > 0
                        changed = True
                if changed:
                    batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                yield batch.filter(pa.array(keep)) if not keep.all() else batch

        out = out.mapInArrow(lean(block_pass), schema)
    return out


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["last"] - s["first"])
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "spans")
