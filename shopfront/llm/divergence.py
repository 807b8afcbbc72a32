"""Source divergence audit: how the word use of each source differs from the other sources of its language.

Each task holds slices of text as Arrow buffers and builds a pointer to every place where a term begins. The pointers are
sorted by multikey quicksort, eight characters at a step: three-way partition by a pivot, the middle part goes on at the
next eight; small parts are sorted by the eight characters at once. Runs of equal terms then give, per language, source
and term, the occurrences and the documents, which Spark adds up over all slices.

A term is kept in a language where at least `least` of its documents hold it. Smoothed shares are p = 1 +
floor(10**9 * (count + 5) / (N + 5 V)), in exact decimals, of a source and of the language. The distance of two sources is the sum
of their differences over all kept terms. Terms are dealt into buckets and sources into blocks; a task adds up the
differences of one bucket for the sources of two blocks, so what it holds is bounded however many sources or terms there are.

Defined results. Null text, language or source counts as ''. A language without kept terms (V = 0) has distances 0 and no
terms. A source alone in its language has no pairs. Repeated documents count each; ids play no part, nor do other columns.
Equal values are ranked by the item's UTF-8 bytes. No documents: no rows.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, lean, removed, written
from .word_runs import word_slices
from .words import LOWER, byte_set

LETTERS = byte_set((0x61, 0x7A), (0x80, 0xFF))
#: Bytes of text whose pointers a task sorts at a time.
SLICE_BYTES = 1 << 23
#: Parts of the pointers below this size are sorted by eight characters at once.
SMALL = 1 << 16
#: A term is kept in a language if so many of its documents hold it.
LEAST = 30
#: What each term and each source is given besides its count.
SMOOTH = 5
SCALE = 1_000_000_000
TOP = 50
#: Kept terms up to which they are broadcast to the counts; beyond, both sides are shuffled.
BROADCAST_TERMS = 200_000
#: Kept terms of a bucket, about, and sources of a block: a task holds 2 * BLOCK * BUCKET shares.
BUCKET = 4096
BLOCK = 128


# ------------------------------------------------------------------ pointers
def eight(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one number, first byte highest; zero at and after the end of the term. data has eight bytes to spare."""
    every = np.ndarray(len(data) - 7, ">u8", data, strides=(1,))
    left = np.minimum(np.maximum(end - at, 0), 8)
    key = every[np.minimum(at, len(every) - 1)].astype(np.uint64)
    return np.where(left > 0, key >> (8 * (8 - np.maximum(left, 1))).astype(np.uint64) << (8 * (8 - np.maximum(left, 1))).astype(np.uint64), np.uint64(0))


def goes_on(key: np.ndarray) -> np.ndarray:
    """Whether terms of these eight bytes may have more: terms hold no zero byte."""
    return key & np.uint64(0xFF) != 0


def edges(run: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a new run begins, in pointers sorted by (run, key)."""
    new = np.ones(len(key), bool)
    new[1:] = (run[1:] != run[:-1]) | (key[1:] != key[:-1])
    return new


def sort_pointers(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the order of the terms by their bytes, the places in it where a run of equal terms begins, and the end).

    Multikey quicksort with a stack in place of recursion. Within a run the pointers keep their order in the text.
    """
    order = np.arange(len(start))
    begins = np.zeros(len(start) + 1, bool)
    begins[0] = begins[-1] = True
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    stack = [(0, len(start), 0, eight(data, start, end))] if len(start) else []
    while stack:
        lo, hi, depth, key = stack.pop()
        if key is None:
            key = eight(data, start[order[lo:hi]] + depth, end[order[lo:hi]])
        if hi - lo > SMALL:
            sample = np.sort(key[:: 1 + (hi - lo) // 64])
            pivot = sample[len(sample) // 2]
            less, same = key < pivot, key == pivot
            parts = [np.flatnonzero(less), np.flatnonzero(same), np.flatnonzero(~(less | same))]
            order[lo:hi] = order[lo:hi][np.concatenate(parts)]
            a, b = lo + len(parts[0]), lo + len(parts[0]) + len(parts[1])
            begins[a] = begins[b] = True
            stack += [(x, y, depth, key[p]) for x, y, p in ((lo, a, parts[0]), (b, hi, parts[2])) if y - x > 1]
            if b - a > 1 and goes_on(pivot):
                stack.append((a, b, depth + 8, None))
            continue
        # a small part: by its eight characters, then all its runs of several terms at once by the next eight
        by = np.argsort(key, kind="stable")
        order[lo:hi] = order[lo:hi][by]
        place, key = np.arange(lo, hi), key[by]
        new = edges(np.zeros(len(key), np.int64), key)
        while True:
            begins[place[new]] = True
            run = np.cumsum(new)
            more = goes_on(key) & (np.bincount(run)[run] > 1)
            if not more.any():
                break
            place, run, depth = place[more], run[more], depth + 8
            rows = order[place]
            key = eight(data, start[rows] + depth, end[rows])
            by = np.lexsort((key, run))
            order[place] = rows[by]
            key, run = key[by], run[by]
            new = edges(run, key)
    return order, np.flatnonzero(begins)


def runs(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, and of each term and group of rows: the term's number, the group, occurrences, rows that hold it)."""
    low = LOWER[data]
    inside = LETTERS[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]])
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    if not len(start):
        return [], *(np.zeros(0, np.int64) for _ in range(4))
    order, begins = sort_pointers(low, start, end)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))[order]
    run = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    # pointers of a run are in the order of the text, so a row's are neighbours
    first = np.concatenate([[True], (row[1:] != row[:-1]) | (run[1:] != run[:-1])])
    many = int(group.max()) + 1
    key = run * many + group[row]
    by = np.argsort(key, kind="stable")
    key = key[by]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    occurrences = np.diff(np.append(new, len(key)))
    rows = np.add.reduceat(first[by].astype(np.int64), new)
    head = order[begins[:-1]]
    raw = low.tobytes()
    terms = [raw[a:b] for a, b in zip(start[head].tolist(), end[head].tolist())]
    return terms, key[new] // many, key[new] % many, occurrences.astype(np.int64), rows


def count_terms(batches):
    """For mapInArrow: (lang, source, text) to (lang, source, term, n, docs), partial counts."""

    def out(names, terms, number, group, n, docs):
        pick = pa.array(group, pa.int64())
        text = pa.array(terms, pa.binary()).cast(pa.string()).take(pa.array(number, pa.int64()))
        return pa.RecordBatch.from_arrays([names[0].take(pick), names[1].take(pick), text, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        pair = pd.MultiIndex.from_arrays([batch.column(0).to_pandas(), batch.column(1).to_pandas()])
        code, pairs = pd.factorize(pair)
        names = [pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)]
        waiting: tuple[int, dict] | None = None  # the counts of a long text that came in several slices
        for lo, hi, data, offsets in word_slices(batch.column(2), LETTERS_ANY_CASE, SLICE_BYTES):
            if waiting and waiting[0] != lo:
                yield out(names, *whole(waiting, code))
                waiting = None
            terms, number, group, n, docs = runs(data, offsets, code[lo:hi])
            if hi - lo > 1:
                yield out(names, terms, number, group, n, docs)
                continue
            held = waiting[1] if waiting else {}
            for t, k in zip(terms, n.tolist()):
                held[t] = held.get(t, 0) + k
            waiting = (lo, held)
        if waiting:
            yield out(names, *whole(waiting, code))


LETTERS_ANY_CASE = LETTERS | byte_set((0x41, 0x5A))


def whole(waiting: tuple[int, dict], code: np.ndarray):
    """The counts of one text, which is one document for each of its terms."""
    row, held = waiting
    return list(held), np.arange(len(held)), np.full(len(held), code[row]), np.fromiter(held.values(), np.int64, len(held)), np.ones(len(held), np.int64)


# ------------------------------------------------------------------ shares
def share(n, total, kept):
    """1 + floor(10**9 * (n + 5) / (total + 5 V)), exactly."""
    up = (F.lit(SCALE).cast("decimal(12,0)") * (n + SMOOTH).cast("decimal(20,0)"))
    down = total.cast("decimal(20,0)") + (F.lit(SMOOTH).cast("decimal(2,0)") * kept.cast("decimal(18,0)"))
    return (F.lit(1) + F.call_function("div", up, down)).cast("bigint")


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term): occurrences n and documents docs."""
    partial = docs.mapInArrow(lean(count_terms), "lang string, source string, term string, n bigint, docs bigint")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def pair_sums(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one language, bucket of terms and pair of blocks: the sums of differences for each pair of sources that the cell has.

    rows: one per source of the cell, with a null term and the share of a term it does not hold, and one per source and term that it holds.
    """
    lang, left, right = rows["lang"].iloc[0], int(rows["left"].iloc[0]), int(rows["right"].iloc[0])
    sources = rows[rows["term"].isna()].sort_values("place")
    held = rows[rows["term"].notna()]
    column, terms = pd.factorize(held["term"])
    place = sources["place"].to_numpy()
    p = np.repeat(sources["p"].to_numpy(np.int64)[:, None], len(terms), axis=1)
    p[np.searchsorted(place, held["place"].to_numpy()), column] = held["p"].to_numpy(np.int64)
    block = place // BLOCK
    out = []
    for a in np.flatnonzero(block == left):
        other = np.flatnonzero((block == right) & (place > place[a]))
        out.append(pd.DataFrame({"a": place[a], "b": place[other], "value": np.abs(p[other] - p[a]).sum(axis=1)}))
    out = pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "value": []})
    return out.assign(lang=lang, seen=len(terms))[["lang", "a", "b", "value", "seen"]].astype({"a": "int64", "b": "int64", "value": "int64"})


def audit(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST, top: int = TOP, bucket: int = BUCKET) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): part `pair` for the other sources of the language, part `term` for the source's own words."""
    spark = docs.sparkSession
    given = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(given(lang_col).alias("lang"), given(source_col).alias("source"), given(text_col).alias("text"))
    paths = [fresh_path(spark, name) for name in ("divergence-counts", "divergence-groups", "divergence-shares", "divergence-kept", "divergence-used")]
    counts = written(term_counts(rows), "divergence-counts", paths[0])
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= least).drop("docs")
    kept = written(kept, "divergence-kept", paths[3])
    few = kept.count() <= BROADCAST_TERMS
    # most terms are rare, so this is far shorter than the counts
    used = written(counts.drop("docs").join(F.broadcast(kept) if few else kept, ["lang", "term"]), "divergence-used", paths[4])
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    # every group that occurs, numbered within its language in the order of the names
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "kept", "lang_total"]).withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    none = F.when(F.col("kept") > 0, share(F.lit(0).cast("bigint"), F.col("total"), F.col("kept"))).otherwise(F.lit(0))
    groups = written(groups.withColumn("p", none), "divergence-groups", paths[1])
    shares = used.join(groups.drop("p"), ["lang", "source"])
    shares = shares.select("lang", "source", "place", "term", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"), "kept")
    shares = written(shares, "divergence-shares", paths[2])

    over = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    own = shares.filter(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    own = own.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= top)
    apart = distances(groups, shares, bucket)
    apart = apart.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value").withColumn("rank", F.row_number().over(over))
    out = written(apart.unionByName(own).withColumn("rank", F.col("rank").cast("int")), "divergence")
    for path in paths:
        removed(spark, path)
    return out


def distances(groups: DataFrame, shares: DataFrame, bucket: int) -> DataFrame:
    """(lang, source, other, value) for every ordered pair of sources of a language."""
    sizes = groups.groupBy("lang").agg(F.max("kept").alias("kept"), (F.floor(F.max("place") / BLOCK) + 1).alias("blocks"))
    sizes = sizes.select("lang", "blocks", F.ceil(F.col("kept") / bucket).alias("buckets"))
    at = F.floor(F.col("place") / BLOCK)
    # the cells of pairs of blocks that a source is part of: (min, max) with every block
    cells = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda k: F.named_struct(F.lit("left"), F.least(k, at), F.lit("right"), F.greatest(k, at)))
    # a term is in one bucket, a source's share of absent terms in all
    marks = groups.join(sizes, "lang").filter("buckets > 0").select("lang", "place", F.lit(None).cast("string").alias("term"), "p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("buckets") - 1)).alias("bucket"), cells.alias("cells"))
    terms = shares.join(sizes, "lang").select("lang", "place", "term", "p", F.pmod(F.xxhash64("term"), F.col("buckets")).alias("bucket"), cells.alias("cells"))
    parts = marks.unionByName(terms).select("lang", "place", "term", "p", "bucket", F.explode("cells").alias("cell")).select("*", "cell.left", "cell.right").drop("cell")
    sums = parts.groupBy("lang", "bucket", "left", "right").applyInPandas(pair_sums, "lang string, a bigint, b bigint, value bigint, seen bigint")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    side = lambda n: groups.select("lang", F.col("place").alias(n), F.col("source").alias(f"{n}_name"), F.col("p").alias(f"{n}_p"), *(["kept"] if n == "a" else []))
    # kept terms that neither block holds
    pairs = side("a").join(side("b"), "lang").filter("a < b").join(sums, ["lang", "a", "b"], "left")
    value = F.coalesce("value", F.lit(0)) + (F.col("kept") - F.coalesce("seen", F.lit(0))) * F.abs(F.col("a_p") - F.col("b_p"))
    pairs = pairs.select("lang", "a_name", "b_name", value.alias("value"))
    both = F.explode(F.array(F.struct(F.col("a_name").alias("source"), F.col("b_name").alias("other")), F.struct(F.col("b_name").alias("source"), F.col("a_name").alias("other"))))
    return pairs.select("lang", both.alias("x"), "value").select("lang", "x.source", "x.other", "value")


def oracle_sql() -> str:
    """The same rows in DuckDB's SQL, over `documents`."""
    lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    share = lambda n, total: f"1 + ({SCALE}::HUGEINT * ({n} + {SMOOTH})) // ({total} + {SMOOTH} * v)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, {lower}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST}),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT d.lang, d.source, (SELECT coalesce(sum(n), 0) FROM c WHERE c.lang = d.lang AND c.source = d.source) AS total FROM (SELECT DISTINCT lang, source FROM d) AS d),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {share("coalesce(c.n, 0)", "g.total")} AS p, {share("k.n", "v.total")} AS q
  FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(a.p - b.p)), 0) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
WHERE part = 'pair' OR rank <= {TOP}"""
