"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a logistic classifier over hashed byte n-grams tells whether a text's language has
that bit; the classifiers of all bits share one pass over the text. Decoding is loss-weighted: each bit's margin counts through the logistic loss, weighted by how well the bit did in
training, and the language whose codeword loses least is chosen. A text is ambiguous if the second is nearly as near, or if
the classifiers' word lies far from every codeword.

Up to seven languages have the exhaustive code (every split of the languages once); more have random balanced columns.

Defined results. Null text or text without a letter: `und`, score 0, ambiguous. No language learnt: `und` everywhere.
One language learnt: that one. Repeated rows are answered each on its own. No rows: no rows. Other columns play no part.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, text_slices

#: Documents of each language that training reads, about; the bound of what the driver gathers. Languages with the most documents first.
SAMPLE = 500
LANGUAGES = 200
#: Characters of a sampled document beyond which it is left out of the sample.
SAMPLE_CHARS = 20_000
#: Buckets of hashed n-grams of one to three bytes.
BUCKETS = 8192
ROUNDS = 200
#: Ambiguous: the best two differ by less of their probability, or the best word's mean loss is above.
MARGIN = 0.2
FAR = 0.9

UNDETERMINED = "und"

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def ngram_shares(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Per row the shares of its n-gram buckets, square-rooted: rows of length 1 that no text's length scales."""
    rows = len(offsets) - 1
    a = _LETTER[data].astype(np.uint32)
    row = np.repeat(np.arange(rows, dtype=np.int64), np.diff(offsets))
    out = np.zeros(rows * BUCKETS, np.float64)
    h = np.zeros(len(a), np.uint32)
    for n in range(1, 4):
        if len(a) < n:
            break
        h = (h[: len(a) - n + 1] * np.uint32(257) + a[n - 1 :]) * np.uint32(2654435761)
        bucket = (h >> np.uint32(7)) % np.uint32(BUCKETS)
        inside = row[: len(bucket)] == row[n - 1 :]
        counted = np.bincount(row[: len(bucket)][inside] * BUCKETS + bucket[inside], minlength=len(out))
        out += counted
    out = out.reshape(rows, BUCKETS)
    total = out.sum(axis=1, keepdims=True)
    return np.sqrt(out / np.maximum(total, 1)).astype(np.float32)


def codewords(languages: int) -> np.ndarray:
    """One row of -1 and 1 per language."""
    if languages <= 1:
        return np.ones((languages, 0))
    if languages <= 7:
        columns = [[1 if i == 0 or (c >> (i - 1)) & 1 else -1 for i in range(languages)] for c in range((1 << (languages - 1)) - 1)]
        return np.array(columns).T
    rng = np.random.default_rng(languages)
    half = np.where(np.arange(languages) % 2 == 0, 1, -1)
    return np.array([rng.permutation(half) for _ in range(int(np.ceil(12 * np.log2(languages))))]).T


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    words: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))
    constant: np.ndarray = field(default_factory=lambda: np.zeros(0))
    trust: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def decode(self, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per row: number of the language, its probability, and whether it is ambiguous."""
        if len(self.languages) == 1:
            return np.zeros(len(shares), int), np.ones(len(shares)), np.zeros(len(shares), bool)
        margins = shares @ self.weights + self.constant
        loss = np.log1p(np.exp(-np.clip(margins[:, None, :] * self.words[None], -30, 30))) @ self.trust
        share = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * len(self.trust))
        share /= share.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        ordered = np.sort(share, axis=1)
        return best, ordered[:, -1], (ordered[:, -1] - ordered[:, -2] < MARGIN) | (loss.min(axis=1) > FAR)


def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def fit(samples: list[tuple[str, str]]) -> Model:
    languages = sorted({lang for _, lang in samples})
    model = Model(languages, codewords(len(languages)))
    bits = model.words.shape[1]
    if len(languages) < 2:
        return model
    x = ngram_shares(*flat([t for t, _ in samples]))
    number = np.array([languages.index(lang) for _, lang in samples])
    y = model.words[number]
    # every language weighs alike
    weight = (1 / np.bincount(number)[number] / len(languages))[:, None].astype(np.float32)
    w, c, momentum = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits), [np.zeros((BUCKETS, bits), np.float32), np.zeros(bits)]
    for _ in range(ROUNDS):
        slope = (-y / (1 + np.exp(np.clip(y * (x @ w + c), -30, 30))) * weight).astype(np.float32)
        momentum = [0.9 * momentum[0] + x.T @ slope + 1e-5 * w, 0.9 * momentum[1] + slope.sum(axis=0)]
        w, c = w - 4 * momentum[0], c - 4 * momentum[1]
    model.weights, model.constant = w.astype(np.float32), c
    right = ((y * (x @ w + c) > 0) * weight).sum(axis=0)
    model.trust = right / right.sum()
    return model


def held_out(id_col: str) -> Column:
    """Documents whose language nothing is learnt from; a null id is none."""
    return F.coalesce(crc_of_id(id_col) % 4 == 2, F.lit(False))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Learns from a bounded sample of the documents that are not held out, chosen by a hash of id and text."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(F.col("lang").isNotNull() & ~held_out("id"))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return Model()
    place = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 30))
    limits = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, int((1 << 30) * min(1.0, sample / n)))])
    chosen = known.filter((place < limits[F.col("lang")]) & F.col("text").rlike(r"\p{L}") & (F.length("text") <= SAMPLE_CHARS)).limit(2 * sample * len(counts))
    rows = chosen.collect()
    return fit([(r.text, r.lang) for r in sorted(rows, key=lambda r: (r.lang, r.id is None, r.id, r.text))])


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score, ambiguous."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    def predict_rows(batches):
        m = shared.value
        names = np.array([*m.languages, UNDETERMINED], object)
        for batch in batches:
            best, score, ambiguous = [np.zeros(0, int)], [np.zeros(0)], [np.zeros(0, bool)]
            for lo, hi, data, offsets in text_slices(batch.column("text"), 1 << 20):
                for a in range(0, hi - lo, 256):  # rows whose shares are in memory at once
                    b = min(hi - lo, a + 256)
                    part = ngram_shares(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    got = m.decode(part) if m.languages else (np.zeros(b - a, int), np.zeros(b - a), np.ones(b - a, bool))
                    for out, x in zip((best, score, ambiguous), got):
                        out.append(x)
            letters = np.asarray(batch.column("letters").to_numpy(zero_copy_only=False), bool) & bool(m.languages)
            best = np.where(letters, np.concatenate(best), len(m.languages))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(names[best].tolist(), pa.string()), pa.array(np.where(letters, np.concatenate(score), 0.0)), pa.array(np.concatenate(ambiguous) | ~letters)], ["id", "lang_pred", "score", "ambiguous"])

    out = rows.mapInArrow(predict_rows, f"id {kind}, lang_pred string, score double, ambiguous boolean")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score", "ambiguous")
