"""The corpus pipeline against the same steps done by brute force."""
import hashlib
import re

import numpy as np
from test_models import brute_secrets
from test_near_dup import brute, shingles
from test_text_operators import brute_contamination, words_of

import corpus_pipeline
from shopfront.llm import byte_bpe, secrets, stages, toxicity
from shopfront.llm.common import table

SF = "/root/testdata/sf0.001"


def masked(text):
    spans = sorted((m.start(), m.end()) for rule in secrets.RULES for m in re.finditer(rule.pattern, text or "", re.ASCII) if not rule.least or len(m.group(rule.group)) >= rule.least)
    out, at = "", 0
    for a, b in spans:
        if a > at or not out:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return out + (text or "")[at:]


def test_run_like_brute_force(spark):
    docs = table(spark, SF, "documents")
    model = toxicity.train(docs, table(spark, SF, "labels"))
    toxic = {r.doc_id for r in toxicity.score(docs, model).collect() if r.predicted}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic]
    kept = {r[0] for r in brute(rows) if r[3]}
    rows = [r for r in rows if r[0] in kept]
    items = [tuple(r) for r in table(spark, SF, "benchmark").collect()]
    dirty = {r[0] for r in brute_contamination(rows, items) if r[5]}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    enc = byte_bpe.encoder(byte_bpe.vocabulary_path())
    assert set(got) <= kept and {i for i, _ in rows} - set(got) <= dirty
    for i, text in rows:
        if i not in dirty:
            ids, out = enc.encode_ordinary(masked(text)), masked(text)
            assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(out.encode()).hexdigest())


def test_every_stage_takes_every_row_and_odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra int"
    rows = [(1, None, "en", "s", 0, 1), (2, "", "en", "s", 0, 2), (None, "no id here at all", None, None, None, 3), (3, "twice the same text here", "fr", "s", 24, 4), (3, "twice the same text here", "fr", "s", 24, 4), (4, "key token=abcdef123456 end of it", "en", "s", 32, 5)]
    docs = spark.createDataFrame(rows, schema)
    items = [tuple(r) for r in table(spark, SF, "benchmark").limit(1).collect()]
    docs = docs.unionByName(spark.createDataFrame([(7, "before " + items[0][1] + " after", "en", "s", 1, 6)], schema))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra"], name
    out = {r.doc_id: r for r in docs.collect()}
    assert docs.count() == 6 and out[4].text == "key [secret] end of it" and out[4].n_chars == 22 and out[1].text is None
    assert words_of(out[7].text)[0] == "before" and words_of(out[7].text)[-1] == "after" and brute_contamination([(7, out[7].text)], items)[0][2] == 0
    assert stages.byte_bpe(spark, docs, SF).count() == 6


def test_no_documents(spark):
    docs = table(spark, SF, "documents").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0 and shingles("") == set() and brute_secrets([]) == []
