"""Toxicity by compression distance.

Each word is written as codes of five bytes that stand for its first three bytes, its first four, and so on up to eight. After
that every character has a code of the six bytes that end with it, so that a word, or a run of a script that sets no spaces, is read to its end;
a word of one or two bytes has one code. So a
stretch of text costs a compressor little only if its dictionary has seen the same beginnings of words, and a seldom letter
costs as much as any other. Two zstandard dictionaries are trained on a bounded sample of labelled documents: one holds what
ordinary text is made of, the other what toxic text is made of, which is that and the stretches that
toxic text has far more often. Each text is cut into overlapping windows that are compressed with both. The saving of the
toxic dictionary on a window is its distance; a logistic curve over a document's largest savings,
fitted on each quarter of the sample under dictionaries of the other three, gives the score.

Defined results. Null or empty text is one empty window: a low score. A sample without toxic or without ordinary documents gives
score 0 everywhere. Repeated rows are scored each on its own. Labels count once per row; null labels and labels of unknown documents
do not count. No rows: no rows. Other columns play no part.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, lean, released, text_slices
from .words import mix, powers

#: Labelled documents that training reads at most, of each class; a fixed sample by hash. This bounds the broadcasts and what the driver gathers.
SAMPLE = {1: 1000, 0: 2400}
#: Characters of a sampled document beyond which it is left out of the sample.
SAMPLE_CHARS = 8_000
#: Bytes of text that a task has codes of at a time.
SLICE_BYTES = 1 << 19
#: Codes in a window, and by how many windows overlap.
WINDOW = 40
OVERLAP = 6
LEVEL = 3
#: A code marks toxic text if it is in so many of its documents, in this share of them, and so many times as often as in ordinary ones.
DOCUMENTS = 4
SHARE = 0.01
TIMES = 8.0
#: Bytes of a word's beginning that codes stand for, and the first of them that has a code: shorter beginnings say nothing, unless they are the word.
REACH = 8
FIRST = 3
#: Bytes that a code after the beginning stands for; more than any character has.
TAIL = 6
CODE_BYTES = 5
#: A window saves if it is shorter by so many bytes.
SAVES = 6
#: Bytes of the stretches both dictionaries hold, and of those that are toxic text's own.
COMMON_BYTES = 1 << 16
MARKED_BYTES = 1 << 16
#: Codes that say whether a sampled document is much like one before it; such a document teaches nothing new.
ALIKE = 24
#: Parts of the sample, each held out once for the curve.
FOLDS = 4
THRESHOLD = 0.7

_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_CODES = np.random.default_rng(31).integers(1, 1 << 63, 256, dtype=np.uint64)


def codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all rows one after the other, and where each row begins. Case is folded and what is no letter counts as one space."""
    rows = len(offsets) - 1
    a = np.full(len(data) + rows + 1, 32, np.uint8)
    a[np.arange(len(data)) + np.repeat(np.arange(rows), np.diff(offsets)) + 1] = _LETTER[data]
    begins = offsets + np.arange(rows + 1)  # the space before each row
    keep = np.ones(len(a), bool)
    keep[1:] = ~((a[1:] == 32) & (a[:-1] == 32))
    keep[begins] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    a, begins = a[keep], place[begins]
    at = np.arange(len(a))
    since = np.maximum.accumulate(np.where(a == 32, at, 0))
    depth = at - since
    after = np.append(a[1:], np.uint8(32))
    whole = (after < 128) | (after >= 192)  # the last byte of a character
    coded = (depth >= FIRST) & (depth <= REACH) | (depth > REACH) & whole | (depth > 0) & (depth < FIRST) & (after == 32)
    since = np.where(depth > REACH, at + 1 - TAIL, since)
    at, since = at[coded], since[coded]
    power, inverse = powers(len(a) + 1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_CODES[a] * power[: len(a)], out=total[1:])
    h = mix((total[at + 1] - total[since]) * inverse[since])
    return h >> np.uint64(64 - 8 * CODE_BYTES), np.concatenate([[0], np.cumsum(coded)])[begins]


def as_bytes(code: np.ndarray) -> bytes:
    return np.ascontiguousarray(code.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CODE_BYTES]).tobytes()


@dataclass
class Model:
    ordinary: bytes = b""
    toxic: bytes = b""
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def compressors(self):
        import zstandard

        made = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (self.ordinary, self.toxic)]
        return [c.compress for c in made]

    def features(self, data: np.ndarray, offsets: np.ndarray, pack) -> np.ndarray:
        """Per row the three largest savings, how many windows save, and the logarithm of the number of windows."""
        code, begins = codes(data, offsets)
        raw, out = as_bytes(code), np.zeros((len(offsets) - 1, 5))
        ordinary, toxic = pack
        for r, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist())):
            windows = [raw[CODE_BYTES * i : CODE_BYTES * min(b, i + WINDOW + OVERLAP)] for i in range(a, max(a + 1, b), WINDOW)]
            saved = sorted((len(ordinary(w)) - len(toxic(w)) for w in windows), reverse=True)
            out[r, : min(3, len(saved))] = saved[:3]
            out[r, 3] = np.log1p(sum(s >= SAVES for s in saved))
            out[r, 4] = np.log(len(saved))
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.zeros(len(features))
        z = self.weights[0] + features @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def blocks(texts: list[str], most: int = 1 << 19) -> Iterator[list[str]]:
    """The texts in runs of about so many characters, so that the arrays made of a run stay small."""
    run, held = [], 0
    for t in texts:
        run.append(t)
        held += len(t)
        if held >= most:
            yield run
            run, held = [], 0
    if run:
        yield run


def each_codes(texts: list[str]) -> Iterator[np.ndarray]:
    """The codes of one text after the other; in memory are those of a run of texts."""
    for run in blocks(texts):
        code, begins = codes(*flat(run))
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist()):
            yield code[a:b]


def stretches(texts: list[str], wanted: np.ndarray, size: int) -> bytes:
    """Dictionary content: the wanted codes where they first stand in the texts, so that those of one word stay together."""
    out, left, most = [], np.unique(wanted), size // CODE_BYTES
    for code in each_codes(texts):
        first = np.sort(np.unique(code, return_index=True)[1])
        found = code[first]
        found = found[np.isin(found, left)]
        if len(found):
            out.append(found)
            left = np.setdiff1d(left, found, assume_unique=True)
        if sum(map(len, out)) >= most or not len(left):
            break
    return as_bytes(np.concatenate(out))[:size // CODE_BYTES * CODE_BYTES] if out else b""


def document_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The codes and in how many of the texts each is."""
    known, counts, fresh, held = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def added():
        code, slot = np.unique(np.concatenate([known, *fresh]), return_inverse=True)
        weight = np.concatenate([counts, np.ones(len(slot) - len(known), np.int64)])
        return code, np.bincount(slot, weight, len(code)).astype(np.int64)

    for code in each_codes(texts):
        fresh.append(np.unique(code))
        held += len(fresh[-1])
        if held >= 1 << 20:
            known, counts = added()
            fresh, held = [], 0
    return added()


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Weights, the constant first, by Newton steps."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step / max(1.0, np.abs(step).max() / 2)
    return w


def unlike(texts: list[str]) -> list[str]:
    """The texts without those that share half of their least pairs of codes with one before them."""
    holders: dict[int, list[int]] = {}
    out = []
    for text, code in zip(texts, each_codes(texts)):
        # codes in pairs a little apart, which unlike documents hardly share
        least = np.unique(mix(code[: max(0, len(code) - 7)] * np.uint64(0x9E3779B97F4A7C15) + code[7:]))[:ALIKE].tolist()
        shared = Counter(i for c in least for i in holders.get(c, ()))
        if not shared or 2 * max(shared.values()) < len(least):
            for c in least:
                holders.setdefault(c, []).append(len(out))
            out.append(text)
    return out


def dictionaries(toxic: list[str], ordinary: list[str]) -> Model:
    (c1, n1), (c0, n0) = document_counts(toxic), document_counts(ordinary)
    least = min(max(DOCUMENTS, SHARE * len(toxic)), max(1, len(toxic) // 4))
    at = np.minimum(np.searchsorted(c0, c1), max(0, len(c0) - 1))
    elsewhere = np.where(c0[at] == c1, n0[at], 0) if len(c0) else np.zeros(len(c1))
    marked = c1[(n1 >= least) & (n1 / len(toxic) >= TIMES * (elsewhere + 0.5) / len(ordinary))]
    usual = np.setdiff1d(c0[np.lexsort((c0, -n0))[: COMMON_BYTES // CODE_BYTES]], marked)
    common, own = stretches(ordinary + toxic, usual, COMMON_BYTES), stretches(toxic, marked, MARKED_BYTES)
    # both of one length, so that zstandard takes the same settings and distances; what fills the place matches nothing
    return Model(np.random.default_rng(1).bytes(len(own)) + common, own + common)


def fit(samples: list[tuple[str, int]]) -> Model:
    """Dictionaries of all sampled documents; the curve from savings of each fold under dictionaries of the others."""
    toxic, ordinary = (unlike([t for t, y in samples if y == k]) for k in (1, 0))
    if len(toxic) < 2 or len(ordinary) < 2:
        return Model()
    x, y = [], []
    for fold in range(folds := min(FOLDS, len(toxic), len(ordinary))):
        inside, held = ([[t for i, t in enumerate(texts) if (i % folds == fold) == out] for texts in (toxic, ordinary)] for out in (False, True))
        model = dictionaries(*inside)
        pack = model.compressors()
        x += [model.features(*flat(run), pack) for run in blocks(held[0] + held[1])]
        y += [1] * len(held[0]) + [0] * len(held[1])
    model = dictionaries(toxic, ordinary)
    model.weights = logistic(np.concatenate(x), np.array(y))
    return model


def held_out(id_col: str) -> Column:
    """Documents whose labels nothing is learnt from; a null id is none."""
    return F.coalesce(crc_of_id(id_col) % 3 == 1, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: dict[int, int]) -> list[tuple[str, int]]:
    """A bounded sample of labelled texts: per class about as many documents as asked for, chosen by a hash of the id."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out("id"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 30))
    parts = [known.filter((F.col("y") == y) & (place < int((1 << 30) * min(1.0, sample[y] / n)))).limit(2 * sample[y]) for y, n in sorted(counts.items())]
    if not parts:
        return []
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    # 2 * SAMPLE rows of two numbers at most
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.length("text") <= SAMPLE_CHARS)
    rows = texts.join(F.broadcast(chosen.groupBy("id").agg(F.max("y").alias("y"))), "id").dropDuplicates(["id"]).select("id", "text", "y").collect()
    return [(r.text, r.y) for r in sorted(rows, key=lambda r: r.id)]


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: dict[int, int] = SAMPLE) -> Model:
    model = fit(sampled(docs, labels, id_col, text_col, label_col, sample))
    released()
    return model


def scored_batches(model, text_col: str):
    """For mapInArrow: the batch and a last column, score."""

    def score(batches):
        pack = None
        for batch in batches:
            m = model.value
            pack = pack or (m.compressors() if len(m.weights) else None)
            # in small parts, as the arrays made of a text are many times as large, and whole rows go back
            for lo, hi, data, offsets in text_slices(batch.column(batch.schema.get_field_index(text_col)), SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                values = m.scores(m.features(data, offsets, pack)) if pack else np.zeros(hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, pa.float64())], [*batch.schema.names, "__score"])

    return score


def with_score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, all columns, and `__score`."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(lean(scored_batches(shared, text_col)), StructType([*docs.schema.fields, StructField("__score", DoubleType())]))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    rows = with_score(docs.select(id_col, text_col), model, text_col)
    return rows.select(id_col, held_out(id_col).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The documents, all columns, without those scored toxic."""
    return with_score(docs, model, text_col).filter(F.col("__score") < THRESHOLD).drop("__score")
