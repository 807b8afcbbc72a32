"""Hot keys, late rows and long runs: the jobs that must not depend on how rows are spread."""
import datetime as dt
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shopfront.operators import cubes, folds, lead_index, near_counts, temporal
from shopfront.operators import duplicates as D
from shopfront.operators import ordered as O
from shopfront.operators.lead_index import LeadIndex
from shopfront.operators.leads import lead_search
from shopfront.operators.snapshot import Snapshot
from shopfront.plans import fixtures
from shopfront.plans.registry import QUERIES, Inputs, load
from shopfront.sources.tables import fresh_pages
from shopfront.streaming import jobs as J

load()
SF = "/root/testdata/sf0.001"
START = dt.datetime(2024, 1, 1)


# ------------------------------------------------------------------ moving average
def sequential(values):
    x = None
    for ms in values:
        x = ms if x is None else (7 * x + 3 * ms + 5) // 10
    return x


def run_of(values):
    run = folds.Run(values[0], [values[0]], [], [])
    for ms in values[1:]:
        run.then(ms)
    return run


@pytest.mark.parametrize("top", [3, 50, 30_000, 10**12])
def test_runs_compose_like_their_steps(top):
    rng = random.Random(top)
    for _ in range(60):
        parts = [[rng.randrange(top) for _ in range(rng.choice([1, 2, 40, 95, 96, 97, 300]))] for _ in range(rng.randrange(1, 5))]
        runs = [run_of(p) for p in parts]
        while len(runs) > 1:  # in any grouping
            i = rng.randrange(len(runs) - 1)
            runs[i : i + 2] = [runs[i].compose(runs[i + 1])]
        flat = [ms for p in parts for ms in p]
        assert runs[0].alone == sequential(flat)
        assert len(runs[0].result) <= 40
        for x in [0, 1, top, rng.randrange(top + 1), rng.randrange(10 * top + 1)]:
            assert runs[0].after(x) == sequential([x, *flat])


def test_average_of_a_source_with_most_of_the_log(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 10 else f"s{i % 7}", i // 3, i, rng.randrange(20_000)) for i in range(20_000)] + [(None, 5, 5, 5), ("hot", 6, 10**6, None), ("one", 1, 1, 77)]
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, "source string, ts long, id long, ms long")
    got = {r.source: r.avg_ms for r in folds.moving_average(log, "source", ["ts", "id"], parts=9).collect()}
    want = defaultdict(list)
    for source, ts, i, ms in sorted((r for r in rows if r[0] and r[3] is not None), key=lambda r: r[1:3]):
        want[source].append(ms)
    assert got == {s: sequential(v) for s, v in want.items()}
    runs = log.dropna().repartitionByRange(9, "source", "ts", "id").withColumn("task", F.spark_partition_id()).filter("source = 'hot'").groupBy("task").count().collect()
    assert len(runs) >= 8 and max(r["count"] for r in runs) < 2 * 18_000 / 8  # spread over all tasks
    assert folds.moving_average(log.filter("false"), "source", ["ts", "id"]).count() == 0


# ------------------------------------------------------------------ places within reach
def brute_reach(places, reach):
    out = {}
    for name, lat, lon, _, _ in places:
        near = [(n, i) for nm, a, b, n, i in places if nm == name and abs(lat - a) < reach and abs(lon - b) < reach]
        out[name, lat, lon] = (sum(n for n, _ in near), min(i for _, i in near))
    return out


@pytest.mark.parametrize("chunk", [1 << 16, 7])
def test_reach_like_all_pairs(spark, chunk):
    rng = random.Random(chunk)
    spots = {("a", 51 + rng.randrange(60) * 0.0001, rng.choice([-1, 1]) * rng.randrange(60) * 0.0001) for _ in range(250)}
    spots |= {("b", rng.uniform(-0.002, 0.002), rng.uniform(-0.04, 0.04)) for _ in range(200)} | {("c", 10.0, 20.0), ("b", 89.99999, 179.99999)}
    places = [(n, a, b, rng.randrange(1, 4), rng.randrange(-50, 1000)) for n, a, b in sorted(spots)]
    df = spark.createDataFrame(places, "name string, lat double, lon double, n long, least long")
    got = {(r.name, r.lat, r.lon): (r.reach, r.least) for r in near_counts.within_reach(df, ["name"], 0.0005, chunk).collect()}
    assert got == brute_reach(places, 0.0005)


def test_a_hundred_thousand_places_in_one_cell(spark):
    rng = np.random.default_rng(3)
    n = 100_000
    lat, lon = 51 + rng.uniform(0, 0.0009, n), -2 + rng.uniform(0, 0.0009, n)
    ids = rng.permutation(n)
    leads = spark.createDataFrame(pd.DataFrame({"id": ids, "name_normalized": "cafe", "lat": lat, "lon": lon, "dedupe_key": None}).astype({"dedupe_key": "object"}), "id bigint, name_normalized string, lat double, lon double, dedupe_key string")
    got = {r.business_id: (r.n_partners, r.group_id) for r in D.possible_duplicates(leads).collect()}
    for i in range(0, n, 2003):
        near = (np.abs(lat[i] - lat) < 0.0005) & (np.abs(lon[i] - lon) < 0.0005)
        assert got[int(ids[i])] == (int(near.sum()) - 1, int(ids[near].min()))
    assert len(got) == n


# ------------------------------------------------------------------ order within a hot key
def test_numbering_a_key_with_all_rows_in_one_day(spark):
    rows = [("k" if i % 50 else f"o{i}", i, f"v{i}") for i in range(4000)]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, "key string, id int, v string")
    dealt = O.bucketed(df, ["key"], [F.col("id")], None)
    sizes = [r["count"] for r in dealt.groupBy("_bucket").count().collect()]
    assert len(sizes) > 2 and max(sizes) <= 2 * len(rows) / len(sizes)
    got = {r.id: r.nth for r in O.numbered(df, ["key"], [F.col("id")], None, "nth").collect()}
    before = {r.id: r.prev for r in O.previous(df, ["key"], [F.col("id")], "v", None, "prev").collect()}
    seen = defaultdict(list)
    for key, i, v in sorted(rows, key=lambda r: r[1]):
        assert got[i] == len(seen[key]) + 1 and before[i] == (seen[key][-1] if seen[key] else None)
        seen[key].append(v)


# ------------------------------------------------------------------ joins in time
def clock(s):
    return None if s is None else START + dt.timedelta(seconds=s)


@pytest.mark.parametrize("strict", [False, True])
def test_as_of_like_a_scan(spark, strict):
    rng = random.Random(7)
    left = [(i, rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, *range(60)]), "l") for i in range(400)]
    right = [(i, rng.choice(["hot", "hot", "a", "none", None]), rng.choice([None, *range(60)]), rng.choice([None, f"r{i}"])) for i in range(150)]
    ldf = spark.createDataFrame([(i, k, clock(t), v) for i, k, t, v in left], "id int, key string, at timestamp, v string")
    rdf = spark.createDataFrame([(i, k, clock(t), v) for i, k, t, v in right], "id int, key string, at timestamp, v string")
    out = temporal.asof_join(ldf, rdf, ["key"], "at", "at", ["v", "id"], "id", strict)
    assert out.columns == ["id", "key", "at", "v", "v_then", "id_then"]
    got = {r.id: (r.v, r.v_then, r.id_then) for r in out.collect()}
    for i, k, t, v in left:
        held = [(rt, ri, rv) for ri, rk, rt, rv in right if k is not None and rk == k and None not in (t, rt) and (rt < t or (rt == t and not strict))]
        assert got[i] == ("l", *((max(held)[2], max(held)[1]) if held else (None, None)))


def interval_rows(spark):
    rng = random.Random(11)
    spans = [(i, rng.choice(["hot", "hot", "a", None]), rng.choice([None, *range(0, 90_000, 700)]), rng.choice([None, *range(0, 90_000, 700)])) for i in range(200)]
    events = [(i, rng.choice(["hot", "a", "z", None]), rng.choice([None, *range(0, 90_000, 350)])) for i in range(300)]
    sdf = spark.createDataFrame([(i, k, clock(a), clock(b)) for i, k, a, b in spans], "task int, key string, a timestamp, b timestamp")
    edf = spark.createDataFrame([(i, k, clock(t)) for i, k, t in events], "event int, key string, at timestamp")
    pairs = [(s, e) for s, k, a, b in spans for e, ek, t in events if k is not None and k == ek and None not in (a, t) and a <= t and (b is None or t < b)]
    return spans, sdf, edf, pairs


def test_events_in_intervals_like_all_pairs(spark):
    spans, sdf, edf, pairs = interval_rows(spark)
    got = [(r.task, r.event) for r in temporal.during(sdf, edf, ["key"], "a", "b", "at", 600).collect()]
    assert sorted(got) == sorted(pairs)  # each once
    counts = Counter(s for s, _ in pairs)
    assert {r.task: r.n for r in temporal.count_during(sdf, edf, ["key"], "task", "a", "b", "at").collect()} == {i: counts[i] for i, *_ in spans}
    assert temporal.during(sdf, edf.filter("false"), ["key"], "a", "b", "at").count() == 0


def test_cells_of_events_are_not_broadcast(spark):
    # few rows before they are placed in cells: by their size Spark would send them to every executor
    events = spark.range(50).select(F.col("id").alias("event"), F.lit(1).alias("key"), F.timestamp_seconds(F.col("id") * 3600).alias("at"))
    spans = spark.range(20).select(F.col("id").alias("task"), F.lit(1).alias("key"), F.timestamp_seconds(F.col("id") * 3600).alias("a"),
                                   F.timestamp_seconds((F.col("id") + 5) * 3600).alias("b"))
    met = temporal.during(spans, events, ["key"], "a", "b", "at")
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.task, r.event) for r in met.collect()) == [(t, e) for t in range(20) for e in range(t, t + 5)]
    nothing = temporal.during(spans.withColumn("b", F.col("a")), events, ["key"], "a", "b", "at")
    assert nothing.count() == 0 and nothing.columns == met.columns


def test_cells_cover_an_interval_once(spark):
    rng = random.Random(2)
    rows = [(a, a + rng.choice([0, 1, 5, 1000, 10**6])) for a in [rng.randrange(-(10**6), 10**6) for _ in range(80)]] + [(0, 2**25)]
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", temporal.time_cells(F.col("a"), F.col("b")).alias("cells"))
    for r in df.collect():
        spans = sorted((c.cell << c.level, (c.cell + 1) << c.level) for c in r.cells)
        assert spans[0][0] == r.a and spans[-1][1] == r.b + 1 and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
        assert len(spans) <= 2 * temporal.LEVELS + 4


# ------------------------------------------------------------------ cube
def test_cube_within_the_stated_error(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("d"), F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") * 7 % 20_011).alias("business_id"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("c"), (F.col("id") % 4).cast("string"))).alias("category"))
    df = df.withColumn("day", F.date_add(F.lit("2024-01-30").cast("date"), F.col("d").cast("int")))
    rows = cubes.activity_cube(df).collect()
    by = Counter(r.level for r in rows)
    assert by == {"day": 3, "week": 1, "month": 2, "category": 4, "month_category": 8, "total": 1}
    (total,) = [r for r in rows if r.level == "total"]
    assert total.n == 60_000 and total.exact == df.select("business_id").distinct().count() - 1
    assert all(abs(r.estimate - r.exact) <= max(1, 4 * cubes.ERROR * r.exact) for r in rows)


# ------------------------------------------------------------------ index
def test_ten_thousand_queries_like_the_scan(spark, tmp_path):
    rng = random.Random(6)
    words = ["Café", "cafe", "Salon", "bar", "Ärger", "42", "4th", "o", "High", "Street"]
    leads = [(i, None if i == 7 else " ".join(rng.choice(words) for _ in range(rng.randrange(0, 4))), rng.choice([None, "1 High St.", "50% & more"])) for i in range(60)]
    df = spark.createDataFrame(leads, "id bigint, name string, address_line string")
    index = LeadIndex(spark, str(tmp_path)).build(df)
    texts = ["caf", "CAFÉ sal", "o", "hig st", "4", "nobody", "", "  ", "&", "_", "%", "sal sal", "a-b", "arg", "cafe nobody"]
    want = {t: sorted(r.id for r in lead_search(df, t).collect()) for t in texts}
    queries = spark.createDataFrame([(i, texts[i % len(texts)]) for i in range(10_000)], "query_id bigint, q string")
    got = defaultdict(list)
    for r in index.search(queries).collect():
        got[r.query_id].append(r.id)
    assert {i: sorted(got[i]) for i in range(10_000)} == {i: want[texts[i % len(texts)]] for i in range(10_000)}


def test_a_search_that_many_ask_and_most_leads_answer_is_dealt_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lead_index, "BLOCK", 16, raising=False)
    monkeypatch.setattr(lead_index, "ROWS_PER_TASK", 5_000, raising=False)
    leads = [(None if i == 9 else i // 2 if i < 6 else i, f"Salon {i % 7}", None) for i in range(300)]  # ids that repeat, and none
    asked = [(None if i == 5 else i, ["%", "", "sal", "7 salon", "salon 3", "3 Sálon", None][i % 7]) for i in range(420)]
    index = LeadIndex(spark, str(tmp_path)).build(spark.createDataFrame(leads, "id bigint, name string, address_line string").coalesce(1))
    found = index.search(spark.createDataFrame(asked, "query_id bigint, q string").coalesce(1))
    shares = [r.n for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(shares) * 4 < sum(shares)
    want = Counter()
    for key, text in asked:
        if text in ("%", ""):
            want.update((key, r[0]) for r in leads)
        elif key is not None and text is not None and text != "7 salon":  # words find no lead without an id
            want.update((key, r[0]) for r in leads if r[0] is not None and (text == "sal" or r[1] == "Salon 3"))
    assert Counter((r.query_id, r.id) for r in found.collect()) == want


def test_a_pair_of_full_blocks_is_unpacked_a_slice_at_a_time(spark):
    ids = spark.range(lead_index.BLOCK)
    one = lead_index.paired(ids.select(F.col("id").alias("query_id"), F.lit("%").alias("search")), ids.select(F.lit("%").alias("search"), "id")).limit(1)
    assert len(one.collect()) == 1
    plans, made = [one._jdf.queryExecution().executedPlan()], []
    while plans:
        plan = plans.pop()
        if plan.nodeName() == "Generate":
            made.append(plan.metrics().apply("numOutputRows").value())
        inner = {"AdaptiveSparkPlan": "executedPlan", "ResultQueryStage": "plan"}.get(plan.nodeName())
        plans += [getattr(plan, inner)()] if inner else [plan.children().apply(i) for i in range(plan.children().size())]
    # one row was taken, and what was unpacked for it does not grow with the product of two blocks
    assert made and 1 <= max(made) <= 16 * lead_index.BLOCK


def test_pairs_of_part_filled_blocks_and_slices_are_whole(spark, monkeypatch):
    monkeypatch.setattr(lead_index, "BLOCK", 10)
    asked = [(q, s) for s, n in (("a", 1), ("b", 23), ("c", 10), ("nobody", 2)) for q in [None, 7, *range(100, 98 + n)][:n]]
    leads = [(s, i) for s, n in (("a", 19), ("b", 8), ("c", 41), ("unasked", 3)) for i in [None, 5, 5, *range(n - 3)]]
    wanted, found = spark.createDataFrame(asked, "query_id bigint, search string"), spark.createDataFrame(leads, "search string, id bigint")
    got = Counter((r.query_id, r.id) for r in lead_index.paired(wanted, found).collect())
    assert got == Counter((q, i) for q, s in asked for t, i in leads if s == t)


# ------------------------------------------------------------------ streams
def stream_of(spark, folder, batches, schema):
    """One file, and so one micro-batch, after the other."""
    for i, rows in enumerate(batches):
        part = spark.createDataFrame(rows, schema).coalesce(1)
        part.write.mode("overwrite").parquet(f"{folder}/tmp{i}")
        (name,) = [f for f in os.listdir(f"{folder}/tmp{i}") if f.endswith(".parquet")]
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.rename(f"{folder}/tmp{i}/{name}", f"{folder}/in/{i:04d}.parquet")
        os.utime(f"{folder}/in/{i:04d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def files_of(path):
    return sum(f.endswith(".parquet") for _, _, names in os.walk(path) for f in names)


def test_late_rows_reach_their_day(spark, tmp_path):
    rng = random.Random(3)
    kinds = [("task_created", "{}"), *(("stage_change", f'{{"toStage":"{s}"}}') for s in ("contacted", "replied", "won", "lost", "new"))]
    rows = [(clock(rng.randrange(20 * 86_400)), *rng.choice(kinds)) for _ in range(600)]
    batches = [rows[i : i + 50] for i in range(0, 600, 50)]  # in any order
    stream = stream_of(spark, str(tmp_path), batches, "at timestamp, kind string, meta string")
    counters = J.DailyCounters(spark, str(tmp_path / "out"), 4)
    query = J.stream_daily(stream, counters, str(tmp_path / "cp"))
    query.awaitTermination()
    want = defaultdict(Counter)
    for at, kind, meta in rows:
        want[at.date()]["tasks_created" if kind == "task_created" else meta.split('"')[3]] += 1
    got = {r.day: {c: r[c] for c in J.COUNTERS} for r in counters.read().collect()}
    assert got == {d: {c: n[c] for c in J.COUNTERS} for d, n in want.items()}
    top, late = None, 0
    for batch in batches:
        late += sum(top is not None and at < top - dt.timedelta(days=2) for at, *_ in batch)
        top = max([*([top] if top else []), *(at for at, *_ in batch)])
    assert counters.late().count() == late > 0
    # the last batch once more, as after a stop before its commit was logged
    replay = J.start
    again = []
    J.start = lambda df, checkpoint, write, mode: again.append(write)
    try:
        J.stream_daily(stream, counters, "")
    finally:
        J.start = replay
    again[0](spark.createDataFrame(batches[-1], "at timestamp, kind string, meta string"), len(batches) - 1)
    assert {r.day: {c: r[c] for c in J.COUNTERS} for r in counters.read().collect()} == got
    assert files_of(tmp_path / "out" / "days") <= 8


def test_work_keys_with_an_end(spark, tmp_path):
    rng = random.Random(8)
    ttl, day = 86_400, 86_400
    batches = [[(f"k{rng.randrange(12) + 4 * b}", clock(b * day + rng.randrange(day))) for _ in range(30)] + [(None, clock(b * day))] for b in range(50)]
    stream = stream_of(spark, str(tmp_path), batches, "key string, at timestamp")
    query = J.start(J.stream_dedupe(stream, "key", "at", ttl, "0 seconds"), str(tmp_path / "cp"), J.batch_folders(str(tmp_path / "out")), "append")
    query.awaitTermination()
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(states) >= 50 and max(states[25:50]) <= max(states[5:25]) + 12 < 60  # level, though 200 keys have been seen
    got = defaultdict(list)
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        got[r.key].append(r.at)
    want, until = defaultdict(list), {}
    for key, at in sorted((r for b in batches for r in b if r[0]), key=lambda r: r[1]):
        if key not in until or at >= until[key]:
            want[key].append(at)
            until[key] = at + dt.timedelta(seconds=ttl)
    assert {k: sorted(v) for k, v in got.items()} == want
    for times in got.values():
        assert all(b - a >= dt.timedelta(seconds=ttl) for a, b in zip(sorted(times), sorted(times)[1:]))


def test_rescoring_replaces_leads_in_place(spark, tmp_path):
    t = Inputs(spark, SF)
    tables = J.keyed_tables(spark, {"leads": t.business, "phones": t.phone, "emails": t.email, "socials": t.social}, str(tmp_path / "tables"), 4)
    ids = [r.id for r in t.business.select("id").collect()]
    rng = random.Random(2)
    batches = [[(rng.choice([*ids, None]),) for _ in range(10)] for _ in range(8)]
    stream = stream_of(spark, str(tmp_path), batches, "business_id bigint")
    target = Snapshot(spark, str(tmp_path / "scores"), "id", J.SCORES, 4)
    J.stream_rescore(stream, tables, target, str(tmp_path / "cp")).awaitTermination()
    want = {r.id: r.score for r in t.leads().select("id", "score").collect()}
    got = {r.id: r.score for r in target.read().collect()}
    touched = {i for b in batches for (i,) in b if i is not None}
    assert got == {i: want[i] for i in touched}
    assert files_of(tmp_path / "scores") <= 4  # one file a folder, however many batches
    J.replace_keys(target, target.read([0, 1, 2, 3]).limit(5))
    assert {r.id: r.score for r in target.read().collect()} == got


# ------------------------------------------------------------------ rows that take long to parse
@pytest.mark.parametrize("name", ["poi_doc", "poi_doc_2", "fetch"])
def test_short_rows_with_much_work_are_dealt_to_all_cores(spark, name):
    assert getattr(Inputs(spark, SF), name).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_more_rows_are_more_tasks(spark, tmp_path):
    spark.range(3).selectExpr("id AS c_custkey", "'n' AS c_name").write.parquet(str(tmp_path / "customer.parquet"))
    least = spark.sparkContext.defaultParallelism
    assert f"REPARTITION({least})" in fixtures._dealt_text(spark, str(tmp_path / "customer.parquet"))
    spark.range(fixtures.ROWS_PER_TASK * (least + 2) + 1).write.parquet(str(tmp_path / "more.parquet"))
    assert f"REPARTITION({least + 3})" in fixtures._dealt_text(spark, str(tmp_path / "more.parquet"))


def test_phones_are_parsed_once(spark):
    plan = QUERIES["H2_phone_insert"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan.lower() and "parquet" in plan


def test_cache_keys_are_not_computed_in_a_filter(spark):
    plan = fresh_pages(Inputs(spark, SF).fetch, "2024-01-30 12:00:00")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if line.strip(" :+-").startswith("Filter") and "regexp_extract" in line]


def test_page_bodies_of_sites_are_joined_once(spark):
    plan = Inputs(spark, SF).site_page._jdf.queryExecution().optimizedPlan().toString().split("\n")
    # the join that meets the bodies is the outermost one: nothing above it but projections
    depth = [line.index("Join") for line in plan if line.strip(" :+-").startswith("Join")]
    sides = [i for i, line in enumerate(plan) if line.strip(" :+-").startswith("Join")]
    bodies = next(i for i, line in enumerate(plan) if "Relation" in line and "html" in line)
    assert sum(i < bodies for i in sides) == 1 and len(depth) == 3
