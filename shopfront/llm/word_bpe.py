"""Encoding and decoding by a vocabulary of words' parts: byte pairs merged within each word.

The file (JSON of the tokenizers library) names the steps, and this follows them: special tokens are cut out of the
text, what lies between is composed (NFC) and lower-cased, split into words, and each word is written as one symbol
per UTF-8 byte, the last with the mark of a word's end. The symbols form a doubly linked list; a heap holds the rank of
every neighbouring pair that has a merge, with its place. The least rank is merged first, the leftmost of equal ones;
a heap entry whose pair is no longer there is stale and skipped. So a word of n bytes takes n log n steps, however long.
Decoding looks the ids up in the vocabulary and joins its strings as the library does, which names no decoder
here: with one space.

Each text is encoded where it is read, a bounded run of it at a time, and a bounded number of words is remembered per task's worker.

Defined results. Null text counts as empty: no ids, decoded to "". Repeated rows and rows without an id are answered
each on its own; other columns play no part. Characters that this Python's tables do not know are normalised and split by the
library's own rules, as its tables may be newer. An id outside the vocabulary makes decoding fail; null ids are no ids.
"""
from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import TEXT_BYTES, small_batches
from .common import lean

#: Words whose ids a worker remembers.
REMEMBERED = 1 << 18
#: Characters of a text that are split into words at a time; a run ends before white space.
RUN = 1 << 18


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself where it can be printed, else the next one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


def in_class(wanted, last: int) -> str:
    """The code points up to the last whose category is wanted, as ranges of a character class."""
    out, begin = [], None
    for cp in range(last + 2):
        inside = cp <= last and wanted(unicodedata.category(chr(cp)))
        if inside and begin is None:
            begin = cp
        elif not inside and begin is not None:
            out.append((begin, cp - 1))
            begin = None
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@lru_cache(maxsize=2)
def splitting(last: int) -> tuple[re.Pattern, re.Pattern]:
    """(the words of a normalised text, a character that this Python does not know), for texts of code points up to the last.

    Most texts end at U+FFFF, up to which a class is one table. Letters go before the shortened endings, which begin with
    a sign, as that finds the same words sooner. The separators U+001C to U+001F are no white space to the library.
    """
    letter, number = in_class(lambda c: c[0] == "L", last), in_class(lambda c: c[0] == "N", last)
    space = r"\t-\r \x85" + in_class(lambda c: c[0] == "Z", last)
    return re.compile(f"[{letter}]+|'(?:s|t|re|ve|m|ll|d)|[{number}]|[^{space}{letter}{number}]+"), re.compile(f"[{in_class(lambda c: c == 'Cn', last)}]")


BEYOND = re.compile("[\U00010000-\U0010ffff]")


def last_of(text: str) -> int:
    """The last code point that a class for this text has to know of."""
    return sys.maxunicode if not text.isascii() and BEYOND.search(text) else 0xFFFF


class Vocabulary:
    """The file, read once per worker."""

    #: The parts of the file that this code follows; a file with others is refused.
    NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        model, added = read["model"], read["added_tokens"]
        split = read["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if read["normalizer"]["normalizers"] != self.NORMALIZERS or split != self.WORDS or read["decoder"] or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path}: other steps than composed, lower-cased words without a decoder")
        self.path, ids = path, model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.strings: list[str | None] = [None] * (1 + max([*ids.values(), *(t["id"] for t in added)]))
        for s, i in [*ids.items(), *((t["content"], t["id"]) for t in added)]:
            self.strings[i] = s
        self.special = {t["content"]: t["id"] for t in added}
        # a pair of ids as one number
        self.pairs = {(ids[a] << 32) | ids[b]: rank for rank, (a, b) in enumerate(model["merges"])}
        self.merged = [ids[a + b] for a, b in model["merges"]]
        self.ids = ids
        self.letters = byte_letters()
        self.cut = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.known = lru_cache(maxsize=REMEMBERED)(lambda word: tuple(self.merge(self.spelt(word))))
        self._library = None

    def spelt(self, word: str) -> str:
        """One character per UTF-8 byte."""
        return word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode()])

    def merge(self, letters: str) -> list[int]:
        """Ids of a word given as one character per byte."""
        n, find = len(letters), self.ids.get
        symbol = [find(c) for c in letters[:-1]] + [find(letters[-1] + self.end)]
        if None in symbol:  # a byte that the vocabulary lacks has no id
            symbol = [s for s in symbol if s is not None]
            n = len(symbol)
        if n < 2:
            return symbol
        rank_of, merged = self.pairs.get, self.merged
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # an entry is rank and place in one number, so that the least rank comes first and of equal ranks the leftmost
        heap = [(r << 32) | i for i, p in enumerate([(a << 32) | b for a, b in zip(symbol, symbol[1:])]) if (r := rank_of(p)) is not None]
        if not heap:
            return symbol
        heapify(heap)
        while heap:
            entry = heappop(heap)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            # stale: taken into its left neighbour, at the end, or beside another symbol by now
            if symbol[i] < 0 or j == n or rank_of((symbol[i] << 32) | symbol[j]) != rank:
                continue
            symbol[i], symbol[j] = merged[rank], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of((symbol[i] << 32) | symbol[k])) is not None:
                    heappush(heap, (r << 32) | i)
            if (h := before[i]) >= 0 and (r := rank_of((symbol[h] << 32) | symbol[i])) is not None:
                heappush(heap, (r << 32) | h)
        return [s for s in symbol if s >= 0]

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def plain(self, text: str) -> list[int]:
        """Ids of a run without special tokens."""
        out: list[int] = []
        if not text.isascii():
            if splitting(last_of(text))[1].search(text):
                lib = self.library()
                for letters, _ in lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text)):
                    out += self.merge(letters)
                return out
            # the library lower-cases each character by itself, so a sigma at a word's end is like any other
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        words = splitting(last_of(text))[0]
        for ids in map(self.known, words.findall(text)):
            out += ids
        return out

    def encode(self, text: str) -> np.ndarray:
        parts, at = [], 0
        for m in self.cut.finditer(text) if self.cut else ():
            parts += [*self.runs(text[at : m.start()]), np.array([self.special[m.group()]], np.int32)]
            at = m.end()
        parts += self.runs(text[at:] if at else text)
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def runs(self, text: str) -> list[np.ndarray]:
        """Ids in runs that end before a space or line end: nothing composes or joins words across it."""
        out, at = [], 0
        while at < len(text):
            end = len(text)
            if end - at > RUN and (m := re.compile(r"[ \n]").search(text, at + RUN)):
                end = m.start()
            out.append(np.array(self.plain(text[at:end]), np.int32))
            at = end
        return out


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per document: id and ids array<int>."""
    path = path or vocabulary_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def encode_rows(batches):
        words = vocabulary(path)
        for batch in small_batches(batches, "text", TEXT_BYTES):
            ids = [words.encode(t or "") for t in batch.column("text").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))], ["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(lean(encode_rows), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, *, id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """One row per row of (id, ids): id, decoded text, n_tokens and ids_sha256 (over the decimal ids, parted by spaces)."""
    path = path or vocabulary_path()
    kind = encoded.schema[id_col].dataType.simpleString()

    def decode_rows(batches):
        strings = vocabulary(path).strings
        numbers = [str(i) for i in range(len(strings))]
        for batch in small_batches(batches, "ids", TEXT_BYTES // 4):
            rows = [x.values.to_pylist() if x.is_valid else [] for x in batch.column("ids")]
            texts = [" ".join([strings[i] for i in row]) for row in rows]
            digests = [hashlib.sha256(" ".join([numbers[i] for i in row]).encode()).hexdigest() for row in rows]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string()), pa.array([len(r) for r in rows], pa.int64()), pa.array(digests, pa.string())], ["id", "decoded", "n_tokens", "ids_sha256"])

    rows = encoded.select(F.col(id_col).alias("id"), "ids")
    return rows.mapInArrow(lean(decode_rows), f"id {kind}, decoded string, n_tokens bigint, ids_sha256 string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, **how) -> DataFrame:
    """Encodes every text, decodes the ids, and returns the digests of both."""
    id_col = how.get("id_col", "doc_id")
    decoded = decode(encode(docs, **how), id_col=id_col, path=how.get("path"))
    return decoded.select(id_col, "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
