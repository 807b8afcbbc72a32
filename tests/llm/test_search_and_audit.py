"""Word BPE, the divergence audit and lexical search against the library, plain Python and SQL."""
import hashlib
import math
import random
import re
import sys
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import connect, differences

from shopfront.llm import divergence, lexical_search, word_bpe
from shopfront.llm.registry import ORACLES, QUERIES, load
from shopfront.llm.word_runs import word_slices
from shopfront.llm.words import WORD

load()
SF = "/root/testdata/sf0.001"


def docs(spark, texts):
    """Other columns play no part, whatever their names."""
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in texts], "doc_id bigint, text string, id string, n int, term int")


# ------------------------------------------------------------------ word BPE
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_bpe.vocabulary_path())


def ids_of(library, texts):
    return [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_every_character_like_the_library(library):
    words = word_bpe.vocabulary(word_bpe.vocabulary_path())
    # beyond the basic plane all that is neither an ideograph nor unassigned, and some of those
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and (c < 0x10000 or c % 997 == 0 or c < 0x20000 and unicodedata.category(chr(c)) != "Cn")]
    texts = [f"Ab{c}Cd 1{c}!{c}{c} '{c}e" for c in map(chr, points)]
    assert [words.encode(t).tolist() for t in texts] == ids_of(library, texts)


@pytest.mark.parametrize("run", [word_bpe.RUN, 5])
def test_mixed_texts_like_the_library(library, monkeypatch, run):
    monkeypatch.setattr(word_bpe, "RUN", run)
    words, rng = word_bpe.Vocabulary(word_bpe.vocabulary_path()), random.Random(4)
    parts = ["a", "B", "'s", "'RE", " ", "  ", "\n", "é", "é", "Σ", "İ", "1", "²", "!?", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "東", "🙂", "\x1c", "\x85", "ﬁ", "क्", "_", "word", "豈"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(4000)] + ["", "a" * 3000, "the quick " * 300]
    assert [words.encode(t).tolist() for t in texts] == ids_of(library, texts)


def test_word_bpe_of_odd_rows(spark, library):
    rows = [(1, None), (2, ""), (2, "Again and again"), (2, "Again and again"), (None, "No id"), (4, "long " * 60000), (5, "x" * 50000)]
    out = word_bpe.encode(docs(spark, rows))
    assert out.columns == ["doc_id", "ids"]
    got = sorted(((r.doc_id, list(r.ids)) for r in out.collect()), key=str)
    assert got == sorted(((i, ids) for (i, _), ids in zip(rows, ids_of(library, [t or "" for _, t in rows]))), key=str)
    back = {(r.doc_id, r.n_tokens): r.decoded for r in word_bpe.decode(out).collect()}
    assert back[(2, 3)] == "again</w> and</w> again</w>" and back[(1, 0)] == ""
    assert word_bpe.round_trip(docs(spark, [])).count() == 0


def test_word_bpe_of_the_given_documents(spark, library):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r, ids in zip(given, ids_of(library, [r.text or "" for r in given])):
        decoded = library.decode(ids, skip_special_tokens=False)
        want[r.doc_id] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_word_bpe"](spark, SF).collect()} == want


# ------------------------------------------------------------------ slices of words
@pytest.mark.parametrize("most", [3, 7, 100])
def test_long_texts_come_in_whole_words(most):
    import pyarrow as pa

    texts = ["ab cde f ghijklmnop q", "", "é, è", None, "abcdefgh"]
    found = defaultdict(list)
    for lo, hi, data, offsets in word_slices(pa.array(texts), WORD, most):
        for r in range(hi - lo):
            found[lo + r] += re.findall(rb"[0-9a-z\x80-\xff]+", data[offsets[r] : offsets[r + 1]].tobytes())
    assert [found[i] for i in range(5)] == [re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode()) for t in texts]


# ------------------------------------------------------------------ divergence
@pytest.mark.parametrize("small", [2, 40, divergence.SMALL])
def test_pointers_sort_like_the_terms(monkeypatch, small):
    monkeypatch.setattr(divergence, "SMALL", small)
    rng = random.Random(small)
    terms = ["".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 30]))) for _ in range(700)] + ["same" * 5] * 300
    rng.shuffle(terms)
    data = np.frombuffer(" ".join(terms).encode(), np.uint8)
    end = np.cumsum([len(t) + 1 for t in terms]) - 1
    start = end - [len(t) for t in terms]
    order, begins = divergence.sort_pointers(data, start, end)
    assert order.tolist() == sorted(range(len(terms)), key=lambda i: (terms[i], i))
    assert len(begins) - 1 == len(set(terms))


def brute_audit(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [(l, s, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t))) for l, s, t in rows]
    held, counts = defaultdict(Counter), defaultdict(Counter)
    for l, s, w in found:
        held[l].update(set(w))
        counts[l, s].update(w)
    out = []
    for lang in {r[0] for r in rows}:
        kept = {t for t, n in held[lang].items() if n >= least}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        q = share(sum((c for (l, _), c in counts.items() if l == lang), Counter()))
        p = {s: share(c) for (l, s), c in counts.items() if l == lang}
        for s in p:
            apart = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in p if o != s)
            own = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, o) in enumerate(apart)]
            out += [(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(own)]
    return sorted(out)


@pytest.mark.parametrize("bucket,block,slice_bytes", [(4096, 128, 1 << 22), (3, 2, 40)])
def test_audit_like_brute_force(spark, monkeypatch, bucket, block, slice_bytes):
    from pyspark import cloudpickle

    rng = random.Random(9)
    say = lambda: " ".join(rng.choice(["Ab", "ab", "c", "dé", "É", "tion9x", "的", "antidisestablishment", "antidisestablished", "zz"]) for _ in range(rng.choice([0, 3, 20])))
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "s4", "s5", None]), say()) for _ in range(150)]
    rows += [("fr", "only", "mot " * 50), ("it", "x", "..."), ("it", "y", None), ("en", "empty", ""), ("en", "s1", "c " * 300)] + [("en", "s2", "again the same")] * 3
    given = spark.createDataFrame([(*r, 1, 2, "q") for r in rows], "lang string, source string, text string, n int, docs int, term string")
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "SLICE_BYTES", slice_bytes)
    cloudpickle.register_pickle_by_value(divergence)  # so that workers see the changed bounds
    try:
        got = sorted(tuple(r) for r in divergence.audit(given, least=3, top=2, bucket=bucket).collect())
    finally:
        cloudpickle.unregister_pickle_by_value(divergence)
    assert got == brute_audit(rows, 3, 2)


def test_audit_of_no_rows(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_shares_are_exact_beyond_64_bits(spark):
    n, total, kept = 93_000_000_000, 10**15, 10**6
    (row,) = spark.createDataFrame([(n, total, kept)], "n bigint, total bigint, kept bigint").select(divergence.share(*map(lambda c: __import__("pyspark").sql.functions.col(c), ("n", "total", "kept")))).collect()
    assert row[0] == 1 + 10**9 * (n + 5) // (total + 5 * kept)


# ------------------------------------------------------------------ lexical search
def terms_of(text):
    return re.findall(lexical_search.TERM, "".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_search(texts, items, most):
    found = [(i, Counter(terms_of(t))) for i, t in texts]
    found = [(i, c) for i, c in found if c]
    n, total = len(found), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item].update(terms_of(text))
    out = []
    for item, terms in wanted.items():
        scores = []
        for i, c in found:
            m = 100 - 90 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                scores.append((-score, i is None, i))
        scores = sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:most]
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(scores)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_pairs,slice_bytes,cells", [(1 << 18, 1 << 20, 1 << 20), (20, 64, 16)])
def test_search_like_brute_force(spark, monkeypatch, block_pairs, slice_bytes, cells):
    from pyspark import cloudpickle

    rng = random.Random(2)
    words = ["Ab", "c", "dé", "e9", "zz", "的", "tion", "rare1", "rare2"]
    say = lambda n: " ".join(rng.choice(words[: rng.randrange(2, 10)]) for _ in range(n))
    texts = [(i, say(rng.choice([0, 1, 5, 30, 80]))) for i in range(120)] + [(7, None), (8, ""), (None, say(9)), (None, say(9)), (9, "-- !"), (300, "c c tion"), (300, "c c tion"), (-5, "c c tion")]
    items = [(i, say(rng.choice([1, 3, 12]))) for i in range(15)] + [(3, "tion rare1 TION"), (40, None), (41, "..."), (42, "unheard"), (None, "c zz")]
    benchmark = spark.createDataFrame([(i, t, "q", 1) for i, t in items], "item_id bigint, text string, item string, score int")
    monkeypatch.setattr(lexical_search, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(lexical_search, "CELLS", cells)
    cloudpickle.register_pickle_by_value(lexical_search)
    try:
        got = sorted((tuple(r) for r in lexical_search.search(docs(spark, texts), benchmark, most=4, block_pairs=block_pairs).collect()), key=str)
    finally:
        cloudpickle.unregister_pickle_by_value(lexical_search)
    assert got == brute_search(texts, items, 4)


def test_search_of_nothing(spark):
    benchmark = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert lexical_search.search(docs(spark, []), benchmark).count() == 0
    assert lexical_search.search(docs(spark, [(1, "a")]), benchmark.filter("false")).count() == 0
    assert [tuple(r) for r in lexical_search.search(docs(spark, [(1, "a"), (2, None)]), benchmark).collect()] == [(1, 1, 1, lexical_search.math.floor(1000 * math.log(4 / 3)) * (10**9 // 1800))]


def test_values_beyond_64_bits():
    tf, m = np.array([5, 10**10]), np.array([10**3, 10**18])
    assert lexical_search.worth(tf, m).tolist() == [10**9 * a // (1000 * a + 8 * b) for a, b in zip(tf.tolist(), m.tolist())]
    n = np.array([3, 10**9])
    assert lexical_search.lengths(n, 10**10, 10**13).tolist() == [10 + 90 * k * 10**10 // 10**13 for k in n.tolist()]


@pytest.mark.parametrize("name", ["op11_source_divergence", "op13_lexical_search"])
def test_given_documents_like_sql(spark, name):
    for sf in (SF, "/root/testdata/sf0.01"):
        assert differences(QUERIES[name](spark, sf), connect(sf), ORACLES[name]) is None
