"""Byte-level BPE encoding and decoding.

A text of one chunk is encoded where it is read. A longer one is cut into overlapping chunks, rows of their
own, that any task pre-tokenises from the chunk's first character. Pre-tokenising only looks ahead, so two
neighbours agree from the first boundary they share in the overlap: there they are stitched, and the piece
between two stitches is encoded by whichever task holds the chunk. Only boundaries and ids are gathered by
text. Where neighbours share no boundary (one pre-token longer than the overlap) the text is encoded whole.

Equal long texts are encoded once. Decoding joins the bytes of the ids.

Defined results. Null text counts as empty and has no ids. Repeated rows and rows without an id are answered
each on its own. An id outside the ranks makes decoding fail; null ids decode to no bytes.
"""
from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, text_key

#: Characters of a chunk, and how far it reaches into the next.
CHUNK = 32768
OVERLAP = 2048
#: Text that Python holds as ids at a time.
TEXT_BYTES = 1 << 20


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def encoder(path: str):
    """Merges within each match of the pattern; no special tokens. One per Python worker."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes | None]:
    table: list[bytes | None] = [None] * (max(ranks(path).values()) + 1)
    for token, rank in ranks(path).items():
        table[rank] = token
    return table


@lru_cache(maxsize=1)
def pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def boundaries(chunk: str, last: bool) -> list[int]:
    """Where pre-tokens end in a chunk, as far as what follows the chunk cannot move them.

    Only ends behind a character that is not white space: the text up to such an end is split alike
    whether or not more follows.
    """
    n, out = len(chunk), []
    for m in pattern().finditer(chunk):
        end = m.end()
        if (end < n or last) and not chunk[end - 1].isspace():
            out.append(end)
    return out


def stitches(chunks: list[dict], step: int) -> list[tuple[int, int, int]] | None:
    """(chunk, from, to) of the pieces in text positions, or None where two neighbours share no boundary in their overlap.

    chunks in order, each with `tail` (boundaries at or after the next chunk's begin) and `head`
    (boundaries inside the overlap with the one before), both in text positions.
    """
    out, begin = [], 0
    for i, c in enumerate(chunks):
        if i + 1 == len(chunks):
            out.append((i, begin, -1))
            break
        shared = sorted(set(c["tail"]) & set(chunks[i + 1]["head"]))
        shared = [p for p in shared if p >= begin]
        if not shared:
            return None
        out.append((i, begin, shared[0]))
        begin = shared[0]
    return out


def small_batches(batches, column: str, most: int):
    """The rows in batches whose column holds about `most` bytes; what Python makes of them stays small."""
    for batch in batches:
        lo, held = 0, 0
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)) if column == "text" else pa.compute.list_value_length(batch.column(column)), 0).to_pylist()
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(lo, i - lo)
                lo, held = i, 0
            held += size
        if lo < batch.num_rows:
            yield batch.slice(lo)


def encoded_column(texts: pa.Array, path: str) -> pa.Array:
    enc = encoder(path)
    ids = [np.array(enc.encode_ordinary(t) if t else [], np.int32) for t in texts.to_pylist()]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: id and ids array<int>."""
    path = path or vocabulary_path()
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def encode_rows(batches):
        for batch in small_batches(batches, "text", TEXT_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), encoded_column(batch.column(1), path)], ["id", "ids"])

    short = rows.filter(F.length("text") <= chunk).mapInArrow(lean(encode_rows), f"id {kind}, ids array<int>")

    long = rows.filter(F.length("text") > chunk).withColumn("key", text_key())
    texts = long.select("key", "text").dropDuplicates(["key"])
    count = F.ceil(F.length("text") / chunk).cast("int")
    cut = texts.select("key", count.alias("chunks"), F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.col("text").substr(i * chunk + 1, F.lit(chunk + overlap)))).alias("chunk", "text"))

    def pre_tokenise(batches):
        for batch in small_batches(batches, "text", TEXT_BYTES):
            heads, tails = [], []
            for i, n, text in zip(batch.column("chunk").to_pylist(), batch.column("chunks").to_pylist(), batch.column("text").to_pylist()):
                ends = boundaries(text, i + 1 == n)
                heads.append([i * chunk + e for e in ends if e <= overlap] if i else [])
                tails.append([i * chunk + e for e in ends if e >= chunk] if i + 1 < n else [])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("chunk"), pa.array(heads, longs), pa.array(tails, longs)], ["key", "chunk", "head", "tail"])

    # dealt out by chunk, so that the chunks of one text are read side by side
    marks = cut.repartition(F.col("key"), F.col("chunk")).mapInArrow(lean(pre_tokenise), "key binary, chunk int, head array<bigint>, tail array<bigint>")

    def stitch(marks_of_text):
        chunks = marks_of_text.sort_values("chunk").to_dict("records")
        pieces = stitches(chunks, chunk)
        import pandas as pd

        if pieces is None:
            pieces = [(-1, 0, -1)]
        return pd.DataFrame({"key": [chunks[0]["key"]] * len(pieces), "piece": [p[0] for p in pieces], "begin": [p[1] for p in pieces], "end": [p[2] for p in pieces]})

    pieces = marks.groupBy("key").applyInPandas(stitch, "key binary, piece int, begin bigint, end bigint")

    def encode_pieces(batches):
        for batch in small_batches(batches, "text", TEXT_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("piece"), encoded_column(batch.column("text"), path)], ["key", "piece", "ids"])

    begin, end = F.col("begin") - F.col("piece") * chunk, F.when(F.col("end") < 0, F.lit(chunk + overlap)).otherwise(F.col("end") - F.col("piece") * chunk)
    parts = cut.join(pieces.filter("piece >= 0"), (cut["key"] == pieces["key"]) & (cut["chunk"] == pieces["piece"])).select(
        cut["key"], "piece", F.col("text").substr((begin + 1).cast("int"), (end - begin).cast("int")).alias("text"))
    whole = texts.join(pieces.filter("piece < 0").select("key", "piece"), "key").select("key", "piece", "text")
    encoded = parts.unionByName(whole).mapInArrow(lean(encode_pieces), "key binary, piece int, ids array<int>")
    joined = encoded.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda p: p["ids"])).alias("ids"))
    stitched = long.select("id", "key").join(joined, "key").select("id", "ids")
    return short.unionByName(stitched).select(F.col("id").alias(id_col), "ids")


def decode(encoded: DataFrame, *, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """One row per row of (id, ids): id, bytes, n_tokens and ids_sha256 (over little-endian 32-bit ids)."""
    path = path or vocabulary_path()
    kind = encoded.schema[id_col].dataType.simpleString()

    def decode_rows(batches):
        table = token_bytes(path)
        for batch in small_batches(batches, "ids", TEXT_BYTES // 4):
            rows = [np.asarray(x.values) if x.is_valid else np.zeros(0, np.int32) for x in batch.column("ids")]
            raw = [b"".join([table[i] for i in row.tolist()]) for row in rows]
            digests = [hashlib.sha256(row.astype("<u4").tobytes()).hexdigest() for row in rows]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(raw, pa.binary()), pa.array([len(r) for r in rows], pa.int64()), pa.array(digests, pa.string())], ["id", "bytes", "n_tokens", "ids_sha256"])

    rows = encoded.select(F.col(id_col).alias("id"), "ids")
    return rows.mapInArrow(lean(decode_rows), f"id {kind}, bytes binary, n_tokens bigint, ids_sha256 string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, **how) -> DataFrame:
    """Encodes every text, decodes the ids, and returns the digests of both."""
    id_col = how.get("id_col", "doc_id")
    decoded = decode(encode(docs, **how), id_col=id_col, path=how.get("path"))
    return decoded.select(id_col, "n_tokens", "ids_sha256", F.sha2(F.col("bytes"), 256).alias("decoded_sha256"))
