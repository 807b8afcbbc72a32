"""Extraction, encoding, decontamination, archives and shards against brute force and round trips."""
import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from shopfront.llm import byte_bpe, decontaminate, html_text, sharding, warc
from shopfront.llm.fm_index import FmIndex
from shopfront.llm.registry import QUERIES, load

load()
SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, n_words string"


def docs(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "other") for i, t in texts], schema)


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_contamination(texts, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add(item)
    lengths = {len(k) for k in windows}
    out = []
    for doc, text in texts:
        w, hit, found = words_of(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[p] - {None}
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


# decontamination


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(5)
    s = np.concatenate([rng.integers(1, 5, 700), [0]])
    index = FmIndex(s, 5)
    patterns = np.array([rng.integers(1, 5, 4) for _ in range(60)])
    lengths = rng.integers(1, 5, 60)
    lo, hi = index.search(patterns, lengths)
    for p, n, a, b in zip(patterns, lengths, lo, hi):
        want = [i for i in range(len(s) - n + 1) if (s[i : i + n] == p[:n]).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_contamination_like_brute_force(spark, block_bytes):
    rng = random.Random(3)
    vocabulary = ["Ab", "c", "dé", "e9", "zz", "tion", "的"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([1, 4, 10, 11, 14]))) for i in range(12)] + [(3, None), (None, say(4)), (40, " .. "), (41, "c, C; c")]
    texts = [(i, say(rng.choice([0, 3, 9, 40, 200]))) for i in range(60)] + [(7, None), (None, items[2][1]), (8, ""), (9, "--" + (items[0][1] or "") + "--"), (9, items[1][1]), (9, items[1][1])]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.digests(decontaminate.find(docs(spark, texts), benchmark, block_bytes=block_bytes, shard_bytes=900)).drop("spans")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_contamination(texts, items)


def test_contamination_of_the_given_documents(spark):
    texts = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = QUERIES["op3_decontamination"](spark, SF).drop("spans")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_contamination(texts, items)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_cut_text_holds_no_phrase(spark, block_bytes):
    a, b = " ".join(f"w{i}" for i in range(12)), " ".join(f"v{i}" for i in range(10))
    benchmark = spark.createDataFrame([(1, a), (2, b)], "item_id bigint, text string")
    halves = a.split()
    texts = [(1, f"Before, {a.upper()}! After"), (2, a), (3, "clean text"), (4, None), (5, ""), (6, " ".join(halves[:6]) + " " + b + " " + " ".join(halves[6:]) + " end")]
    out = {r.doc_id: r for r in decontaminate.remove(docs(spark, texts), benchmark, block_bytes=block_bytes).collect()}
    assert out[1].text == "Before, ! After" and out[1].n_words == "other"
    assert 2 not in out and out[3].text == "clean text" and out[4].text is None and out[5].text == ""
    assert words_of(out[6].text) == ["end"]


def test_contamination_of_no_rows(spark):
    none, benchmark = docs(spark, []), spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.find(none, benchmark).count() == 0
    (row,) = decontaminate.digests(decontaminate.find(docs(spark, [(1, "a b")]), benchmark)).collect()
    assert (row.n_words, row.n_hit, row.contaminated) == (2, 0, False)


# encoding

HARD = ["", " ", "\n\n  \t x", "don't  I'll\r\n\r\n  go", "naïve 東京 ١٢٣ 🙂🙂 end   ", "a" * 400, "  " * 300 + "b", "x  y \n\tb", "1" * 90 + " 22 " + "!?" * 50, "word " * 300, "<|endoftext|> s"]


@pytest.mark.parametrize("chunk,overlap", [(32768, 2048), (64, 16), (16, 3)])
def test_encoding_like_the_library(spark, chunk, overlap):
    rng = random.Random(chunk)
    texts = list(enumerate(HARD + ["".join(rng.choice(["ab", " ", "  ", "\n", "'s", "9", "é", ".", " the", "\t"]) for _ in range(rng.randrange(400))) for _ in range(40)]))
    texts += [(1, None), (None, "no id " * 30), (2, "again " * 40), (2, "again " * 40)]
    got = byte_bpe.encode(docs(spark, texts), chunk=chunk, overlap=overlap)
    enc = byte_bpe.encoder(byte_bpe.vocabulary_path())
    want = sorted(((i, enc.encode_ordinary(t or "")) for i, t in texts), key=str)
    assert sorted(((r.doc_id, list(r.ids)) for r in got.collect()), key=str) == want
    back = byte_bpe.decode(got).collect()
    assert sorted(bytes(r.bytes).decode() for r in back) == sorted(t or "" for _, t in texts)


def test_digests_of_the_given_documents(spark):
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    enc = byte_bpe.encoder(byte_bpe.vocabulary_path())
    want = {}
    for r in texts:
        ids = enc.encode_ordinary(r.text or "")
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op2_byte_bpe"](spark, SF).collect()} == want


def test_encoding_of_no_rows(spark):
    assert byte_bpe.round_trip(docs(spark, [])).count() == 0


# archives


def brute_archive(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        payload = (h or "").encode()
        least = first.get(h or "")
        revisit = least is not None and i != least
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", least if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("range_bytes", [211, 1 << 22])
def test_archives_come_back(spark, range_bytes):
    rng = random.Random(1)
    noise = "".join(chr(rng.randrange(32, 3000)) for _ in range(5000))
    rows = [(i, f"http://h/{i}", "x" * (i % 4)) for i in range(20)] + [(50, None, None), (51, "u\r\nWARC-Type: x", noise), (52, "", noise), (52, "", noise), (None, "n", "only"), (None, "n", "x"), (60, "g", "\x1f\x8b\x08WARC/1.1\r\n")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    manifest = warc.write(pages, id_col="page_id", url_col="url", payload_col="html", archive_bytes=3000)
    back = warc.read(manifest, range_bytes=range_bytes).collect()
    responses = [h for i, _, h in rows if not (4 <= i < 20 if i is not None and i < 50 else i in (50, 52) or (i, h) == (None, "x"))]
    assert sorted(bytes(r.payload).decode() for r in back if r.record_type == "response") == sorted(responses)
    got = warc.round_trip(pages, id_col="page_id", url_col="url", payload_col="html").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_archive(rows)


def test_a_member_that_only_looks_like_one_is_passed_over(tmp_path):
    inner = warc.member(9, "http://inner/", b"no record", None)
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored, so that the inner member's bytes stand in the file
    payload = b"y" * 50 + inner + b"z" * 50
    http = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}\r\nContent-Length: {len(http)}\r\n\r\n".encode()
    outer = packer.compress(head + http + b"\r\n\r\n") + packer.flush()
    data = outer + warc.member(2, "http://b/", b"b", None)
    (tmp_path / "a").write_bytes(data)
    fs, name = warc.file_system(str(tmp_path / "a"))
    for step in (1, 100, len(data)):
        with fs.open_input_file(name) as f:
            window = warc.Window(f, len(data))
            ids = [r[0] for b in range(0, len(data), step) for r in warc.owned(window, b, min(len(data), b + step))]
        assert ids == ["<urn:page:1>", "<urn:page:2>"]


def test_archives_of_the_given_pages(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted((tuple(r) for r in QUERIES["op4_warc"](spark, SF).collect()), key=str) == brute_archive(rows)


def test_archives_of_no_rows(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


# shards


def brute_shards(rows, shards=8):
    keyed = []
    for i, t in rows:
        raw = (t or "").encode()
        keyed.append((int(hashlib.md5(raw).hexdigest()[:15], 16), -(1 << 63) if i is None else i, i, len(raw) + 1, zlib.crc32(raw)))
    keyed.sort(key=lambda k: k[:2])
    total, upto, slots, out = sum(k[3] for k in keyed), 0, defaultdict(int), []
    for _, _, i, size, crc in keyed:
        shard = min(shards - 1, (2 * upto + size) * shards // (2 * total))
        out.append((i, size, crc, "bytes", shard, slots[shard], None))
        slots[shard] += 1
        upto += size
    return sorted(out, key=str)


@pytest.mark.parametrize("how", [{}, {"least": 4, "range_bytes": 300, "sample": 64}])
def test_shards_like_brute_force(spark, how):
    rng = random.Random(2)
    rows = [(i, "é" * rng.randrange(60)) for i in range(150)] + [(200 + i, "hot text of many rows") for i in range(200)] + [(None, None), (500, None), (None, ""), (501, "long " * 500)]
    got = sharding.assign(docs(spark, rows), **how)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_shards(rows)


def test_shards_of_the_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op7_sharding"](spark, SF).collect()), key=str) == brute_shards(rows)


def test_shards_of_no_rows_and_of_equal_rows(spark):
    assert sharding.assign(docs(spark, [])).count() == 0
    got = sharding.assign(docs(spark, [(1, "same")] * 20), 4).collect()
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in range(4) for i in range(5)]


# main text


def extracted(spark, pages, **how):
    df = spark.createDataFrame([(i, u, h, 1) for i, u, h in pages], "page_id bigint, url string, html string, text int")
    return {r.page_id: r.text for r in html_text.extract(df, **how).collect()}


def test_marked_boilerplate_goes(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>H</header><nav><ul><li>N</ul></nav><div class="cookie-notice">C</div>
    <article><h1>Title &amp; more</h1><p>One <b>bo</b>ld&nbsp; &#233;<br>two<script>var x="</p>"</script><p>Three &lt;4</p><div id=comments><p>bad</p></div>
    <form><input>F</form><aside>S</aside></article><div class='ad'>A</div><footer>&copy; F</footer>"""
    cut = "<body><nav>x</nav><article><p>whole &am"
    got = extracted(spark, [(1, "http://a/1", page), (2, None, None), (3, "http://a/", ""), (4, "http://a/", cut), (5, "http://b/", "just text < 5 > 4")])
    assert got == {1: "Title & more One bold é two Three <4", 2: "", 3: "", 4: "whole &am", 5: "just text < 5 > 4"}


def test_subtrees_that_recur_on_a_host_go(spark):
    page = lambda i: f"<body><div><p>Welcome to our shop</p><p><a href=/>Home</a></p></div><div><p>Story {i} is told.</p><p>It ends.</p></div><div>Call us</div></body>"
    pages = [(i, f"http://Shop.example:80/{i}", page(i)) for i in range(20)] + [(100 + i, f"http://h{i}.example/", page(i)) for i in range(20)]
    got = extracted(spark, pages)
    # the second paragraph recurs as well; without a main element that is what the method takes for template
    assert all(got[i] == f"Story {i} is told." for i in range(20))
    assert all(got[100 + i] == f"Welcome to our shop Home Story {i} is told. It ends. Call us" for i in range(20))


def test_template_of_a_host_does_not_hang_on_its_size(spark):
    noted = [(i, "http://a/x", f"<body><div>We close at noon</div><div>Story {i}</div></body>") for i in range(6)]
    more = [(100 + i, "http://a/y", f"<body><div>Page {i}</div></body>") for i in range(600)]
    small, large = extracted(spark, noted), extracted(spark, noted + more)
    assert {i: small[i] for i in range(6)} == {i: large[i] for i in range(6)} == {i: f"Story {i}" for i in range(6)}


def test_copies_and_passages_of_an_article_stay(spark):
    copy = "<body><div>menu</div><article><p>Same text</p><p>everywhere</p></article></body>"
    bare = "<body><div>Bare copy</div></body>"
    linked = lambda i: f"<article><p>Text {i}</p><p>Licence line</p><div><a href=/>More</a> <a href=/b>like this</a></div></article>"
    pages = [(i, "http://a/x", copy) for i in range(30)] + [(100 + i, "http://a/y", bare) for i in range(30)] + [(200 + i, "http://a/z", linked(i)) for i in range(30)]
    got = extracted(spark, pages)
    assert {got[i] for i in range(30)} == {"Same text everywhere"} and {got[100 + i] for i in range(30)} == {"Bare copy"}
    assert all(got[200 + i] == f"Text {i} Licence line" for i in range(30))


def test_articles_of_the_given_pages(spark):
    # what the pages hold between the article tags, read another way
    import html

    got = {r.page_id: r.text for r in QUERIES["op1_html_extraction"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = r.html.partition("<article>")[2].partition("</article>")[0]
        assert got[r.page_id] == " ".join(html.unescape(re.sub(r"</?(?:h1|p|b|br)>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inner)).split())


def test_pages_of_no_rows(spark):
    assert extracted(spark, []) == {}


def test_ranges_are_read_by_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    rng = random.Random(1)
    pages = spark.createDataFrame([(i, f"http://a/{i}", "".join(rng.choice("abcdefgh ") for _ in range(4000))) for i in range(200)], "page_id bigint, url string, html string")
    manifest = warc.write(pages, str(tmp_path / "archives"), archive_bytes=1 << 17)
    back = warc.read(manifest, range_bytes=1 << 13)
    assert back.withColumn("task", F.spark_partition_id()).select("task").distinct().count() >= 8
    assert back.count() == 200
