"""Near duplicates against brute force."""
import random
import re

import numpy as np

from shopfront.llm import near_dup
from shopfront.llm.graph import components
from shopfront.llm.registry import QUERIES, load

load()
SF = "/root/testdata/sf0.001"


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    out = [(d, len(sets[i]), least.get(root(i)), d == least.get(root(i))) for i, (d, _) in enumerate(rows)]
    return sorted(out, key=str)


def edited(rng, words, share, pool):
    return " ".join(rng.choice(pool) if rng.random() < share else w for w in words)


def corpus():
    rng = random.Random(9)
    pool = [f"w{i}" for i in range(500)]
    say = lambda n: [rng.choice(pool) for _ in range(n)]
    passage = say(60)
    texts = [" ".join(say(rng.randrange(1, 120))) for _ in range(60)]
    texts += [" ".join(passage + say(20)) for _ in range(40)]  # much shared, yet not alike enough
    base = say(150)
    texts += [edited(rng, base, 0.01, pool) for _ in range(120)] + [edited(rng, base, 0.03, pool) for _ in range(60)]
    chain = say(100)
    for i in range(12):  # each like the next, the ends unlike
        texts.append(" ".join(chain[:100]))
        chain = chain[5:] + say(5)
    texts += [texts[5]] * 30 + [texts[70].upper(), "", " \t", None, "one two", "One  two", "a b c d", "a b c d e"]
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(None, texts[0]), (None, None), (None, "no id at all here to be seen"), (3, texts[3]), (3, texts[3]), (4, texts[9])]


def test_like_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, kept string")
    assert sorted((tuple(r) for r in near_dup.find(df).collect()), key=str) == brute(rows)


def test_one_of_each_stays(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, class string")
    out = near_dup.deduplicate(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    kept = {x[0] for x in brute(rows) if x[3] and x[1]}
    want = {(d, t) for d, t in rows if d in kept and shingles(t)}
    firsts = [x for x in got if shingles(x[1])]
    assert len({d for d, _ in firsts}) == len(firsts) and set(firsts) <= want and {d for d, _ in want} == {d for d, _ in firsts}
    assert sorted((x for x in got if not shingles(x[1])), key=str) == sorted((x for x in rows if not shingles(x[1])), key=str)


def test_the_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op5_minhash_near_dedup"](spark, SF).collect()), key=str) == brute(rows)


def test_without_pivots_the_same(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(near_dup, "ROUNDS", 0)
    assert sorted((tuple(r) for r in near_dup.find(df).collect()), key=str) == brute(rows)


def hub_corpus(rng):
    """Pages of one template alike below the threshold, a hub in their middle, and two of the pages linked with each other only."""
    hub = [f"h{i}" for i in range(400)]

    def page(k, places):
        return [f"p{k}x{i}" if i in places else w for i, w in enumerate(hub)]

    some = lambda n: set(rng.sample(range(10, 390, 6), n))
    pages = [page(k, some(15)) for k in range(30)]
    places = rng.sample(range(10, 390, 6), 20)
    return [(i, " ".join(w)) for i, w in enumerate([hub, *pages, page(30, set(places[:15])), page(30, set(places[5:]))])]


def test_a_pair_beside_pivots_without_links(spark):
    rows = hub_corpus(random.Random(0))
    want = brute(rows)
    assert [x[:1] + x[2:] for x in want if not x[3]] == [(32, 31, False)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((tuple(r) for r in near_dup.find(df).collect()), key=str) == want


def test_no_rows_and_no_links(spark):
    assert near_dup.find(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    got = near_dup.find(spark.createDataFrame([(1, "a b c d e f"), (2, None)], "doc_id bigint, text string")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, 1, True), (2, 0, 2, True)]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 300)] + [(rng.randrange(400, 500), rng.randrange(400, 500)) for _ in range(40)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(200):
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    lonely = {u for u, v in edges if u == v} - {x for u, v in edges if u != v for x in (u, v)}
    assert got == {k: v for k, v in label.items() if k not in lonely}


def test_signature_agreement_follows_similarity():
    rng = np.random.default_rng(0)
    common, rest = rng.integers(0, 1 << 63, 600, dtype=np.uint64), rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    a, b = np.unique(np.concatenate([common, rest[:100]])), np.unique(np.concatenate([common, rest[100:]]))
    sign = near_dup.signatures([a, b])
    assert abs((sign[0] == sign[1]).mean() - 0.75) < 0.25


def test_columns_of_any_name_stay(spark):
    text = "one two three four five six seven"
    df = spark.createDataFrame([(1, text, 77, "k", True), (2, text, 78, "l", False), (None, None, 79, "m", None)], "doc_id bigint, text string, id int, key string, solo boolean")
    got = near_dup.deduplicate(df)
    assert got.columns == df.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(1, text, 77, "k", True), (None, None, 79, "m", None)], key=str)


def test_two_blocks_give_a_forest_of_their_links():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[: 390 - i], rng.integers(0, 1 << 62, 10, dtype=np.uint64)])) for i in range(12)] + [np.unique(rng.integers(0, 1 << 62, 400, dtype=np.uint64)) for _ in range(3)]
    sketch, sign = near_dup.sketches(sets), near_dup.signatures(sets)

    def block(which):
        rows = [{"node": i, "label": i, "n": len(sets[i]), "sketch": sketch[i].tobytes(), "signature": sign[i].tolist(), "shingles": sets[i].view(np.int64).tolist()} for i in which]
        kind = pa.struct([("node", pa.int64()), ("label", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary()), ("signature", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64()))])
        return near_dup.Classes(pa.array(rows, kind))

    whole, left, right = block(range(15)), block(range(0, 15, 2)), block(range(1, 15, 2))
    u, v = near_dup.met_links(whole, whole, True)
    assert len(u) == 11 and (u < v).all() and set(u.tolist() + v.tolist()) == set(range(12))
    u, v = near_dup.met_links(left, right, False)
    assert len(u) <= 14 and set(u.tolist() + v.tolist()) == set(range(12))
