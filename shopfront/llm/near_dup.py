"""Near duplicates by an inverted join over signature coordinates.

Documents with equal shingle sets form a class; only classes are compared. A class is posted under the value of
each of its `COORDINATES` MinHash coordinates. Two sets as alike as asked for agree in at least
`LEAST` coordinates, but for a chance below 1e-6 per pair (at similarity 0.75; it falls fast above). So values that one class alone has
are dropped, and with them classes left with fewer than LEAST; the rest are kept under their rarest values only, the prefix, in which classes
that agree in LEAST coordinates meet at least once.

Long posting lists are not paired out. First each class is compared with one class, the pivot, that it shares
most of its lists with; a list's pivot is its most central class, the one whose coordinate values most classes have. Confirmed links join
classes, and lists whose classes are joined are done. Later rounds take other members of a list's main component as pivots. Then the classes of lists still open are compared
across components: the lists of one main component are a group, cut into blocks of a bounded number of bytes, and a task meets two blocks with their
sketches, signatures and sets. Pairs whose sketches differ in few enough bits and that agree in enough coordinates are confirmed there on the full
sets, unless links found before join them already. What leaves the task is a spanning forest of the links, shorter than the classes of its two blocks.
A link inside a component changes no result, so none that matters is lost.

Defined results. Null or empty text, or text without words: no shingles, component of its own, kept. With fewer words than a shingle the
whole sequence is one. Repeated rows are copies of each other. A null id is larger than any id: a component takes the smallest
id that is not null, null only if it has no other; such a row is kept if its component has none. No rows: no rows. Other columns play no part.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, text_key, text_slices, written
from .graph import components
from .words import NOT_SPACE, mix, shingle_sets, words_of

#: Words of a shingle; the similarity asked for, in percent.
SHINGLE = 5
PERCENT = 75
#: Signature length, and the agreement below which a pair is not looked at: P(Binomial(48, 0.75) < 20) = 2e-7.
COORDINATES = 48
LEAST = 20
PREFIX = COORDINATES - LEAST + 1
#: Bits of the sketch, each from a MinHash value of its own, and by how many links may differ: P(Binomial(4096, 0.125) > 628) = 4e-8.
SKETCH = 4096
DIFFER = 628
#: Bytes of a block's classes, about: sketch, signature and set of each.
BLOCK_BYTES = 1 << 23
#: Rounds of pivots.
ROUNDS = 2
#: Stands for a null id.
NO_ID = (1 << 63) - 1

_RANDOM = np.random.default_rng(50)
_FACTORS = _RANDOM.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RANDOM.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_SKETCH_FACTORS = _RANDOM.integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

PREPARED = "id bigint, text_key binary, n_shingles bigint, class binary, signature array<bigint>"


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row per set that is not empty: per coordinate a key of coordinate and least hash value."""
    sets = [s for s in sets if len(s)]
    out = np.zeros((len(sets), COORDINATES), np.uint64)
    if sets:
        values = np.concatenate(sets)
        begins = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        for k in range(COORDINATES):
            out[:, k] = np.minimum.reduceat(values * _FACTORS[k] + _TERMS[k], begins)
    return mix(out + _TERMS * np.uint64(3)).view(np.int64)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of SKETCH / 64 longs per set; no set is empty."""
    bits = np.zeros((len(sets), SKETCH), np.uint8)
    values = np.concatenate(sets)
    begins = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    for k in range(SKETCH):
        bits[:, k] = mix(np.minimum.reduceat(values * _SKETCH_FACTORS[k], begins)) & np.uint64(1)
    return np.packbits(bits, axis=1).view(np.int64)


def prepare(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """PREPARED, one row per document."""

    def rows(batches):
        for batch in batches:
            sizes, classes, keys = [], [], []
            for _, _, data, offsets in text_slices(batch.column("text")):
                sets = shingle_sets(words_of(data, offsets, NOT_SPACE), SHINGLE)
                sizes += map(len, sets)
                classes += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                keys.append(signatures(sets))
            keys = np.concatenate(keys) if keys else np.zeros((0, COORDINATES), np.int64)
            ends = np.concatenate([[0], np.cumsum([COORDINATES if n else 0 for n in sizes])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1)))],
                ["id", "text_key", "n_shingles", "class", "signature"])

    text = docs.select(F.col(id_col).cast("bigint").alias("id"), text_key(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    return text.mapInArrow(lean(rows), PREPARED)


def prefixes(classes: DataFrame) -> DataFrame:
    """(key, node, n, central): the postings under which classes that may have a partner are kept."""
    postings = classes.select("node", "n", F.explode("signature").alias("key"))
    shared = postings.groupBy("key").agg(F.count("*").alias("posted")).filter("posted > 1")
    listed = postings.join(shared, "key").groupBy("node", "n").agg(F.sum("posted").alias("central"), F.array_sort(F.collect_list(F.struct("posted", "key"))).alias("listed"))
    # up to COORDINATES values per class, the rarest first; without those that no other class has, the prefix is as much shorter
    spare = COORDINATES - F.size("listed")
    kept = F.slice("listed", F.lit(1), F.greatest(F.lit(1), F.lit(PREFIX) - spare))
    return listed.filter(F.size("listed") >= LEAST).select("node", "n", "central", F.explode(kept).alias("p")).select("p.key", "node", "n", "central")


def shingle_tables(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) for the given (node, id, text_key)."""

    def rows(batches):
        for batch in batches:
            sets: list[np.ndarray] = []
            for _, _, data, offsets in text_slices(batch.column("text")):
                sets += shingle_sets(words_of(data, offsets, NOT_SPACE), SHINGLE)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))], ["node", "shingles"])

    text = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), text_key(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    # by id and text, so that copies of one text do not meet; rows that repeat give one
    found = text.join(nodes, ["id", "text_key"]).select("node", "text").mapInArrow(lean(rows), "node bigint, shingles array<bigint>")
    return found.dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) that are links by their full sets."""
    a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    alike = 100 * both >= PERCENT * (F.size("a") + F.size("b") - both)
    return pairs.join(a, "u").join(b, "v").filter(alike).select("u", "v")


def size_fits(a: str, b: str):
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def open_lists(state: DataFrame, key: str) -> DataFrame:
    """(key, main): the lists that hold several components, and the component that most of their classes are in."""
    parts = state.groupBy(key, "label").agg(F.count("*").alias("part"))
    return parts.groupBy(key).agg(F.max_by("label", F.struct("part", "label")).alias("main"), F.count("*").alias("parts")).filter("parts > 1").select(key, "main")


def pivot_pairs(state: DataFrame, round_: int) -> DataFrame:
    """Pairs (u, v) of a class and the pivot of another component that it shares most lists with."""
    central = F.col("central") if round_ == 0 else F.xxhash64("node", F.lit(round_))
    pivots = state.groupBy("key").agg(F.max_by(F.struct("node", "label", "n"), F.struct(F.col("label") == F.col("main"), central, "node") if round_ else F.struct(central, "node")).alias("p"))
    met = state.select("key", "node", "n", "label").join(pivots, "key").filter((F.col("label") != F.col("p.label")) & size_fits("n", "p.n"))
    met = met.groupBy("node", F.col("p.node").alias("pivot")).agg(F.count("*").alias("times"))
    return met.groupBy("node").agg(F.max_by("pivot", F.struct("times", "pivot")).alias("pivot")).select(F.col("node").alias("u"), F.col("pivot").alias("v"))


def met_links(a: "Classes", b: "Classes", same: bool) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (u, v) of the links between the classes of two blocks, or of one with itself, across components."""
    part = np.concatenate([a.label, b.label])  # the component of each class so far
    out = []
    for i in range(len(a.node)):
        fits = (part[len(a.node) :] != part[i]) & (100 * np.minimum(b.n, a.n[i]) >= PERCENT * np.maximum(b.n, a.n[i]))
        if same:
            fits[: i + 1] = False
        at = np.flatnonzero(fits)
        at = at[np.bitwise_count(b.sketch[at] ^ a.sketch[i]).sum(axis=1, dtype=np.int64) <= DIFFER]
        at = at[(b.signature[at] == a.signature[i]).sum(axis=1) >= LEAST]
        for j in at.tolist():
            own, other = part[i], part[len(a.node) + j]
            if own == other:
                continue
            both = len(np.intersect1d(a.set(i), b.set(j), assume_unique=True))
            if 100 * both >= PERCENT * (a.n[i] + b.n[j] - both):
                out.append((a.node[i], b.node[j]))
                part[part == other] = own
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs.min(axis=1, initial=NO_ID), pairs.max(axis=1, initial=-1)


class Classes:
    """The classes of a block, out of its row."""

    def __init__(self, rows: pa.StructArray):
        self.node, self.label, self.n = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("node", "label", "n"))
        self.sketch = np.frombuffer(b"".join(rows.field("sketch").to_pylist()), np.uint64).reshape(len(rows), -1)
        self.signature = rows.field("signature").flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        self.sets = rows.field("shingles").flatten().to_numpy(zero_copy_only=False)
        self.begins = np.concatenate([[0], np.cumsum(self.n)])

    def set(self, i: int) -> np.ndarray:
        return self.sets[self.begins[i] : self.begins[i + 1]]


def links_across(state: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) that join different components among the classes of open lists, confirmed; of each pair of blocks a forest."""

    def sketch_rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # rows whose values are in memory at once
                part = batch.slice(at, 64)
                rows = sketches([np.asarray(x.values).view(np.uint64) for x in part.column("shingles")])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([r.tobytes() for r in rows], pa.binary())], [*part.schema.names, "sketch"])

    nodes = state.select("node", "label", "n").distinct().join(sets, "node").join(classes.select("node", "signature"), "node")
    sketched = nodes.select("node", "label", "signature", "shingles").mapInArrow(lean(sketch_rows), "node bigint, label bigint, signature array<bigint>, shingles array<bigint>, sketch binary")
    members = state.select("main", "node", "n").distinct()
    size = 8 * F.col("n") + SKETCH // 8 + 8 * COORDINATES + 64
    groups = members.groupBy("main").agg(F.ceil(F.sum(size) / BLOCK_BYTES).cast("int").alias("blocks"))
    placed = members.drop("n").join(groups, "main").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(sketched, "node")
    row = F.struct("node", "label", F.size("shingles").cast("bigint").alias("n"), "sketch", "signature", "shingles")
    packed = written(placed.groupBy("main", "block", "blocks").agg(F.collect_list(row).alias("rows")), "class-blocks")
    left = packed.select("main", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("block"), (F.col("block")).alias("own"), F.col("rows").alias("a"))
    both = left.join(packed.select("main", "block", F.col("rows").alias("b")), ["main", "block"])

    def compare(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (Classes(batch.column(c)[k].values) for c in ("a", "b"))
                u, v = met_links(a, b, batch.column("own")[k].as_py() == batch.column("block")[k].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return both.select("a", "b", "own", "block").mapInArrow(lean(compare), "u bigint, v bigint").distinct()


def links(lists: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame | None:
    """(node, label) of the classes that are linked with others, None without any. lists: (key, node, n, central)."""
    state, found = lists.withColumn("label", F.col("node")), None
    for round_ in range(ROUNDS + 1):
        state = written(state.join(open_lists(state, "key"), "key"), "open-lists")
        if state.isEmpty():
            break
        new = confirmed(pivot_pairs(state, round_), sets) if round_ < ROUNDS else links_across(state, classes, sets)
        new = written(new if found is None else new.unionByName(found), "links")
        if new.isEmpty():
            # no link with a pivot says nothing about the other pairs of the lists
            state = state.drop("main")
            continue
        labels = components(new)
        # stars stand for all links so far
        found = labels.filter("node != label").select(F.col("node").alias("u"), F.col("label").alias("v"))
        state = state.drop("label", "main").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    return None if found is None else found.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(found.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, text_key, n_shingles, component_id, kept, solo), one row per document, and its classes; solo marks rows without words."""
    prepared = written(prepare(docs, id_col, text_col), "signatures")
    grouped = prepared.filter("n_shingles > 0").groupBy("class").agg(
        F.min(F.struct(F.coalesce("id", F.lit(NO_ID)).alias("id"), "text_key")).alias("first"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    classes = written(grouped.select(F.monotonically_increasing_id().alias("node"), "class", "first.id", "first.text_key", "n", "signature"), "classes")
    lists = written(prefixes(classes), "prefixes")
    members = classes.join(lists.select("node").distinct(), "node").select("node", "id", "text_key")
    sets = written(shingle_tables(docs, members, id_col, text_col), "shingles")
    labels = links(lists, classes, sets)
    least = classes.select("node", "class", "id")
    if labels is not None:
        labelled = classes.join(labels, "node").select("class", "label", "id")
        first = labelled.groupBy("label").agg(F.min("id").alias("id"))
        joined = labelled.select("class", "label").join(first, "label").select("class", "id")
        least = least.join(labels.select("node"), "node", "left_anti").select("class", "id").unionByName(joined)
    out = prepared.select("id", "text_key", "n_shingles", "class").join(least.select("class", F.col("id").alias("component")), "class", "left")
    own = F.col("n_shingles") == 0
    component = F.when(own, F.col("id")).otherwise(F.nullif("component", F.lit(NO_ID)))
    out = out.withColumn("component_id", component).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    return out.select("id", "text_key", "n_shingles", "component_id", "kept", own.alias("solo")), classes


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept."""
    out, _ = near_duplicates(docs, id_col=id_col, text_col=text_col)
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, of which one of each component stays; documents without words all stay."""
    found, _ = near_duplicates(docs, id_col=id_col, text_col=text_col)
    kept = found.filter("kept OR solo").select(F.coalesce("id", F.lit(NO_ID)).alias("id"), F.col("text_key").alias("key"), "solo").distinct()
    # the document as one value, so that its columns may have any names
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(NO_ID)).alias("id"), text_key(f"`{text_col}`").alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).join(kept, ["id", "key"])
    empty = rows.filter("solo")
    # several rows of one id in one component: the first by text; where no document of a component has an id, one per text
    first = found.filter("kept AND NOT solo").groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("text_key")).alias("alone")).agg(F.min("text_key").alias("key"))
    first = first.select(F.coalesce("component_id", F.lit(NO_ID)).alias("id"), "key")
    one = rows.filter("NOT solo").join(first, ["id", "key"], "left_semi").dropDuplicates(["id", "key"])
    return empty.unionByName(one).select("doc.*")
