"""Jobs on small tables: the behaviour that the SQL comparison does not show."""
import datetime as dt
import glob
import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shopfront import dims
from shopfront.operators import duplicates as D
from shopfront.operators import edits as E
from shopfront.operators import enrichment as N
from shopfront.operators import leads as L
from shopfront.operators import ordered as O
from shopfront.operators import poi as P
from shopfront.operators import robots as R
from shopfront.operators import stats as S
from shopfront.operators import tiles as T
from shopfront.operators.folds import moving_average
from shopfront.sources import tables as SRC

NOW = "2024-01-30 12:00:00"


def pois(spark, *elements):
    body = json.dumps({"elements": [{"type": "node", "lat": 51.23, "lon": -2.32, **e} for e in elements]})
    return P.elements(spark.createDataFrame([(body,)], "body string"))


def normal(spark, *elements):
    return {r.osm_key: r for r in P.normalize(pois(spark, *elements)).collect()}


# ------------------------------------------------------------------- POIs
def test_new_businesses(spark):
    rows = normal(
        spark, {"id": 1, "tags": {"name": "Kettle Corner", "amenity": "cafe", "addr:city": "Wells"}},
        {"id": 2, "tags": {"name": "Clip Room", "shop": "hairdresser", "website": "https://www.facebook.com/cliproom"}},
        {"id": 3, "tags": {"name": "Brook Pipes", "craft": "plumber", "phone": "+44 1749 654321", "email": "info@brookpipes.co.uk",
                           "contact:instagram": "https://instagram.com/brookpipes"}},
        {"id": 5, "tags": {"amenity": "cafe"}}, {"id": 6, "tags": {"name": "Closed Cafe", "amenity": "cafe", "disused": "yes"}},
        {"id": 7, "tags": {"name": "Gone", "shop": "bakery", "lifecycle": "disused"}}, {"id": 8, "tags": {"name": "B", "shop": "bakery", "website": "https://b.co.uk"}})
    assert {k: r.site_state for k, r in rows.items()} == {"node/1": "no_tag", "node/2": "social_only", "node/3": "social_only", "node/8": "has_tag_unprobed"}
    assert rows["node/2"].website_url is None and rows["node/1"].city == "Wells" and rows["node/3"].category == "trades"
    assert rows["node/3"].phones == ["+44 1749 654321"] and rows["node/3"].emails == ["info@brookpipes.co.uk"]


def test_upsert_is_idempotent_and_keeps_old_site(spark):
    el = {"id": 4, "tags": {"name": "The Oat Oven", "shop": "bakery", "website": "https://oatoven.co.uk"}}
    empty = spark.createDataFrame([], "osm_key string, first_seen_at timestamp, last_seen_at timestamp")
    first = P.upsert(empty, P.normalize(pois(spark, el)), "2024-01-01")
    el2 = {"id": 4, "tags": {"name": "Oat & Co Bakery", "shop": "bakery", "website": "https://other.co.uk"}}
    again = P.upsert(first.drop("is_new"), P.normalize(pois(spark, el2)), "2024-01-02").collect()
    assert [r.is_new for r in first.collect()] == [True] and len(again) == 1
    r = again[0]
    assert (r.is_new, r.name, r.website_url, r.dedupe_key) == (False, "Oat & Co Bakery", "https://oatoven.co.uk/", "oatoven.co.uk")
    assert (r.first_seen_at, r.last_seen_at) == (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))


def test_social_website_becomes_an_account(spark):
    n = P.normalize(pois(spark, {"id": 2, "tags": {"name": "F", "website": "https://www.facebook.com/cliproom"}}))
    assert [(r.platform, r.handle) for r in P.all_socials(n).collect()] == [("facebook", "cliproom")]


def test_response_triage(spark):
    cases = [("<!DOCTYPE html><html><body>Error</body></html>", 200, "unavailable"), (json.dumps({"remark": "runtime error: Query timed out", "elements": []}), 200, "server_timeout"),
             (json.dumps({"remark": "note: something harmless", "elements": [{"id": 1}]}), 200, "ok"), (json.dumps({"version": 0.6}), 200, "bad_request"), ("", 200, "unavailable"),
             ("<html>OSM3S Response Error : runtime error: Query timed out in</html>", 200, "server_timeout"), ("<title>504 Gateway Time-out</title>", 504, "unavailable"),
             ("not json at all", 200, "bad_request"), (json.dumps({"elements": []}), 200, "ok"), (json.dumps({"elements": []}), 503, "unavailable"), ("<p>no</p>", 404, "bad_request")]
    df = P.triage(spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, body string, status int, want string"))
    assert [r.failure_kind for r in df.orderBy("i").collect()] == [c[2] for c in cases]


def test_poi_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"elements": [{"type": "way", "id": 7, "center": {"lat": 1.5, "lon": 2.5}, "tags": {"name": "X"}}]}, indent=1))
    rows = P.located(SRC.read_pois(spark, str(tmp_path / "a.json"))).collect()
    assert [(r.type, r.id, r.lat, r.lon, r.tags) for r in rows] == [("way", 7, 1.5, 2.5, {"name": "X"})]


# -------------------------------------------------------- ordered helpers
def hot(spark, n=400):
    rng = random.Random(5)
    rows = [(i, "hot" if rng.random() < 0.6 else f"k{rng.randrange(6)}", rng.randrange(50)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, key string, v int")


def test_numbering_and_previous_over_a_hot_key(spark):
    rows, df = hot(spark)
    numbered = {r.id: r.nth for r in O.numbered(df, ["key"], [F.col("id")], F.floor(F.col("id") / 16), "nth").collect()}
    before = {r.id: r.prev for r in O.previous(df, ["key"], [F.col("id")], "v", F.floor(F.col("id") / 16), "prev").collect()}
    seen: dict = {}
    for i, key, v in rows:
        assert numbered[i] == len(seen.setdefault(key, [])) + 1
        assert before[i] == (seen[key][-1] if seen[key] else None)
        seen[key].append(v)


def test_previous_keeps_null_values_and_skips_empty_buckets(spark):
    df = spark.createDataFrame([(0, "a", None), (1, "a", 5), (90, "a", 7)], "id int, key string, v int")
    got = {r.id: r.prev for r in O.previous(df, ["key"], [F.col("id")], "v", F.floor(F.col("id") / 10), "prev").collect()}
    assert got == {0: None, 1: None, 90: 5}


@pytest.mark.parametrize("kind", ["varied", "constant", "long"])
def test_latency_average_equals_the_sequential_fold(spark, kind):
    rng = random.Random(kind)
    n = 900
    ms = [777 if kind == "constant" and i > 5 else rng.randrange(30000) for i in range(n)]
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=(3 if kind == "long" else 30) * i), "m", i % 7 != 0, ms[i]) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, source string, ok boolean, ms bigint")
    x = None
    for i, _, _, ok, m in rows:
        if ok:
            x = m if x is None else (7 * x + 3 * m + 5) // 10
    assert moving_average(df.filter("ok"), "source", ["ts", "id"]).first().avg_ms == x


# ------------------------------------------------------------- duplicates
def lead_rows(spark, rows):
    return spark.createDataFrame(rows, "id bigint, name_normalized string, lat double, lon double, dedupe_key string")


def brute_pairs(rows, faithful):
    shared = {*dims.SOCIAL_HOSTS, *dims.LINK_HUB_HOSTS}
    def keys(r):
        k = r[4].lower() if r[4] else None
        if faithful:
            return k, r[1]
        return (k if k and "." in k and " " not in k and k not in shared else None), r[1] or None
    out = []
    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            (ka, na), (kb, nb) = keys(a), keys(b)
            if ka is not None and ka == kb:
                out.append((a[0], b[0], "same_domain"))
            elif na is not None and na == nb and None not in (a[2], b[2]) and abs(a[2] - b[2]) < 0.0005 and abs(a[3] - b[3]) < 0.0005:
                out.append((a[0], b[0], "same_name_nearby"))
    return out


@pytest.mark.parametrize("faithful", [True, False])
def test_duplicates_with_a_hot_group(spark, faithful):
    rng = random.Random(3)
    keys = ["Facebook.com", "facebook.com", "a.co", "b.co", None, "1 High Street", None]
    rows = [(i, rng.choice(["cafe", "", "bar"]), rng.choice([None, 51 + rng.randrange(8) * 0.0003]), -2 + rng.randrange(8) * 0.0003,
             "chain.co" if i % 3 == 0 else rng.choice(keys)) for i in range(240)]
    pairs = brute_pairs(rows, faithful)
    counts: dict = {}
    for a, b, reason in pairs:
        for x in (a, b):
            counts[x, reason] = counts.get((x, reason), 0) + 1
    df = lead_rows(spark, rows)
    assert {(r.business_id, r.reason): r.n_partners for r in D.possible_duplicates(df, faithful).collect()} == counts
    page = [(r.business_a, r.business_b, r.reason) for r in D.duplicate_page(df, 150, faithful).collect()]
    assert page == sorted(pairs)[:150]


def test_domains_pair_by_what_their_owner_can_register(spark):
    sites = [f"https://shop{i}.{suffix}/" for i, suffix in enumerate(dims.FREE_HOST_SUFFIXES[:6])] + [f"https://other.{dims.FREE_HOST_SUFFIXES[0]}/x", "https://one.mill-lane.org", "http://two.mill-lane.org/b?c", "https://mill-lane.org", "https://mill-lane.net"]
    n = P.normalize(pois(spark, *({"id": i, "lat": 40.0 + i, "tags": {"name": f"Place {i}", "website": url}} for i, url in enumerate(sites, 1))))
    rows = D.possible_duplicates(n, faithful=True).collect()
    assert sorted((r.business_id, r.reason, r.n_partners, r.group_id) for r in rows) == [(i, "same_domain", 2, 8) for i in (8, 9, 10)]


# ------------------------------------------------------------------- feed
def feed(spark):
    rows = [(20, "Blank Page Diner", "no_tag", True), (21, "Open Door Cafe", "live", False), (22, "Feed First Salon", "social_only", False), (23, "Broken Link Garage", "dead", False)]
    df = spark.createDataFrame(rows, "id bigint, name string, site_state string, has_phone boolean")
    return L.scored(df.withColumns({"has_email": F.lit(False), "has_social": F.lit(False), "tier": F.lit("unknown"), "enrichment_stage": F.lit("none"),
                                    "address_line": F.lit("1 Café Row")}))


def test_feed_filter_and_search(spark):
    df = feed(spark)
    rows, total = L.feed_page(df, 1, 10)
    ranked = rows.collect()
    assert ranked[0].name == "Blank Page Diner" and total.first().total == 4
    assert {r.name: r.score for r in ranked}["Open Door Cafe"] < ranked[0].score
    assert L.lead_filter(df, no_website=True).count() == 3
    names = lambda q: sorted(r.name for r in L.lead_search(df, q).collect())
    assert names("Diner") == ["Blank Page Diner"] and names("page DIN") == ["Blank Page Diner"] and len(names("cafe row")) == 4 and len(names("CAFÉ")) == 4
    for q in ["No Site", "Smith & Sons", "cafe!", '""', "O'Brien", "*", "a-b", "  "]:
        names(q)
    assert [r.name for r in L.lead_filter(df, has_phone=True).collect()] == ["Blank Page Diner"]
    assert [r.id for r in L.feed_page(df, 2, 3)[0].collect()] == [r.id for r in L.feed_sort(df).collect()][3:]


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([(1, 'Joe\'s "Diner", Ltd', "trades", 50, "parked", None, None, None, None, None, "Bath", "gb", "new", dt.datetime(2024, 1, 5))],
                               "id bigint, name string, category string, score int, site_state string, category_label string, website_url string, email string, phone_e164 string,"
                               " phone_raw string, city string, country_code string, pipeline_stage string, first_seen_at timestamp")
    df = df.withColumns({"followers_total": F.lit(None).cast("bigint"), "has_phone": F.lit(False), "has_email": F.lit(False)})
    socials = spark.createDataFrame([(1, "youtube"), (1, "facebook"), (1, "facebook")], "business_id bigint, platform string")
    SRC.write_leads_csv(df, socials, str(tmp_path / "out"))
    data = b"".join(open(f, "rb").read() for f in sorted(glob.glob(str(tmp_path / "out/part=*/*.txt"))))
    assert data.decode("utf-8") == ("﻿" + ",".join(dims.CSV_HEADER) + "\r\n"
                                    '"Joe\'s ""Diner"", Ltd",trades,50,Parked domain,,,,,facebook facebook youtube,Bath,GB,new,2024-01-05\r\n')


# ------------------------------------------------------------------ score
def score_of(spark, rows):
    cols = "site_state string, has_phone boolean, has_email boolean, has_social boolean, tier string, enrichment_stage string"
    return L.scored(spark.createDataFrame(rows, cols))


def test_score_grid_matches_the_double_formula(spark):
    rows = L.score_grid(spark).collect()
    assert len(rows) == 8100
    for r in rows:
        points = {**dims.SITE_POINTS, **dims.PRESET_POINTS[r.preset]}[r.site_state]
        contact = min(30, 12 * r.has_phone + 12 * r.has_email + 6 * r.has_social)
        presence = min(15, 8 * r.has_social + dims.TIER_POINTS[r.tier])
        p, c, s = (r.site_state not in ("unknown", "has_tag_unprobed"), r.enrichment_stage in ("contacts", "socials", "done"), r.enrichment_stage in ("socials", "done"))
        factor = 0.7 + 0.3 * (0.5 * p + 0.3 * c + 0.2 * s)
        assert r.score == max(0, min(100, int((points + contact + presence) * factor + 0.5))), r


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(dims.SITE_STATES), st.booleans(), st.booleans(), st.booleans(), st.sampled_from(list(dims.TIER_POINTS)),
                          st.sampled_from(dims.ENRICHMENT_STAGES)), min_size=1, max_size=20))
def test_scores_stay_in_range_and_grow_with_contacts(spark, rows):
    got = [r.score for r in score_of(spark, rows).collect()]
    more = [r.score for r in score_of(spark, [(s, True, True, h, t, e) for s, _, _, h, t, e in rows]).collect()]
    assert all(0 <= s <= 100 for s in got) and all(a <= b for a, b in zip(got, more))


def test_verified_no_site_beats_verified_live(spark):
    rows = [("no_tag", True, True, False, "unknown", "socials"), ("live", True, True, False, "unknown", "socials"), ("has_tag_unprobed", True, True, True, "atLeast10k", "none")]
    no_site, live, unprobed = [r.score for r in score_of(spark, rows).collect()]
    assert no_site > live and unprobed < no_site


# --------------------------------------------------------- tasks and stats
def test_day_lists_and_untick(spark):
    d = dt.date(2024, 1, 30)
    day = lambda n: d + dt.timedelta(days=n)
    at = dt.datetime(2024, 1, 30, 9)
    rows = [(1, None, "Today", None, d, "open", "call", None, None, at, 1), (2, None, "Overdue", None, day(-3), "open", "call", None, None, at, 1),
            (3, None, "Upcoming", None, day(4), "open", "call", None, None, at, 1), (4, None, "Finished", None, d, "done", "call", at, None, at, 2),
            (5, None, "Far", None, day(31), "open", "call", None, None, at, 1)]
    schema = ("id bigint, business_id bigint, title string, note string, due_date date, status string, channel string, done_at timestamp,"
              " snooze_until timestamp, created_at timestamp, position bigint")
    tasks = spark.createDataFrame(rows, schema)
    assert {r.id: r.bucket for r in S.day_lists(tasks, "2024-01-30").collect()} == {1: "open", 2: "overdue", 3: "upcoming", 4: "done"}
    activity = spark.createDataFrame([], "kind string, day date, meta string")
    leads = spark.createDataFrame([], "first_seen_at timestamp")
    done = lambda t: {r.day: r.tasks_done for r in S.daily_stat(activity, t, leads).collect()}
    patch = lambda status: spark.createDataFrame([(1, None, None, None, status, None)], "id bigint, title string, note string, due_date date, status string, snooze_until timestamp")
    ticked = E.task_patch(tasks, patch("done"), NOW)
    assert done(tasks) == {d: 1} and done(ticked["tasks"]) == {d: 2} and [r.kind for r in ticked["log"].collect()] == ["task_done"]
    undone = E.task_patch(ticked["tasks"], patch("open"), NOW)
    assert done(undone["tasks"]) == {d: 1} and [r.kind for r in undone["log"].collect()] == ["task_undone"]
    assert [r.day for r in undone["days"].collect()] == [d]


@pytest.mark.parametrize("active,want", [([0, -1, -2], 3), ([-1, -2], 2), ([-2, -3], 0), ([], 0), ([0, -2], 1)])
def test_streak(spark, active, want):
    rows = [(dt.date(2024, 1, 30) + dt.timedelta(days=n), 1) for n in active]
    assert S.streak(spark.createDataFrame(rows, "day date, tasks_done bigint"), "2024-01-30").first().n == want


def test_week_change_rounds_half_up(spark):
    rows = [(dt.date(2024, 1, 30), 7, 0), (dt.date(2024, 1, 20), 8, 0)]
    r = S.week_summary(spark.createDataFrame(rows, "day date, tasks_done bigint, leads_found bigint"), "2024-01-30").first()
    assert (r.tasks_done, r.before, r.delta_pct) == (7, 8, -12)


def test_stage_edits_skip_repeats(spark):
    leads = spark.createDataFrame([(1, "new")], "id bigint, pipeline_stage string")
    at = [dt.datetime(2024, 1, d) for d in (1, 3, 9)]
    edits = spark.createDataFrame([(i, 1, a, s) for i, (a, s) in enumerate(zip(at, ["contacted", "contacted", "won"]))], "id bigint, business_id bigint, at timestamp, to_stage string")
    got = [(r.from_stage, r.to_stage) for r in E.stage_events(leads, edits).orderBy("at").collect()]
    assert got == [("new", "contacted"), ("contacted", "won")]
    assert E.stage_change(leads, edits).first().pipeline_stage == "won"
    log = E.stage_log(E.stage_events(leads, edits))
    none = spark.createDataFrame([], "done_at timestamp"), spark.createDataFrame([], "first_seen_at timestamp")
    days = {str(r.day): (r.contacted, r.won) for r in S.daily_stat(log, *none).collect()}
    assert days == {"2024-01-01": (1, 0), "2024-01-09": (0, 1)}


# ------------------------------------------------------------ merge, tiles
def test_merge_keeps_every_contact(spark):
    leads = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    phones = spark.createDataFrame([(1, 1, "a", "+1"), (2, 2, "b", "+1"), (3, 2, "c", None), (4, 3, "d", "+9")], "id bigint, business_id bigint, raw string, e164 string")
    emails = spark.createDataFrame([(1, 2, "x@y.z"), (2, 1, "x@y.z")], "id bigint, business_id bigint, address string")
    socials = spark.createDataFrame([(1, 2, "tiktok", "h")], "id bigint, business_id bigint, platform string, handle_normalized string")
    links = spark.createDataFrame([(1, 5), (2, 5), (2, 6)], "business_id bigint, query_id bigint")
    tasks = spark.createDataFrame([(1, 2), (2, None)], "id bigint, business_id bigint")
    out = E.merge_leads(leads, phones, emails, socials, links, tasks, tasks, spark.createDataFrame([(2, 1)], "drop_id bigint, keep_id bigint"))
    rows = lambda n, *cs: sorted(tuple(r[c] for c in cs) for r in out[n].collect())
    assert rows("leads", "id") == [(1,), (3,)] and rows("phones", "business_id", "raw") == [(1, "a"), (1, "c"), (3, "d")]
    assert rows("emails", "business_id", "address") == [(1, "x@y.z")] and rows("socials", "business_id", "platform") == [(1, "tiktok")]
    assert rows("links", "business_id", "query_id") == [(1, 5), (1, 6)] and {(r.id, r.business_id) for r in out["tasks"].collect()} == {(1, 1), (2, None)}


def test_merges_in_chains_and_given_twice_have_one_target(spark):
    schema = "drop_id bigint, keep_id bigint"
    got = E.final_targets(spark.createDataFrame([(2, 1), (2, 1), (3, 2), (4, 3), (5, 9), (5, 8), (7, 7)], schema))
    assert {r.drop_id: r.keep_id for r in got.collect()} == {2: 1, 3: 1, 4: 1, 5: 8}
    with pytest.raises(ValueError):
        E.final_targets(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], schema))


def test_tiles_keep_every_point_and_stop_at_small_spans(spark):
    rng = random.Random(1)
    rows = [(i, rng.random() ** 3, rng.random()) for i in range(500)] + [(500, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, lat double, lon double")
    got = T.adaptive_tiles(df, (0.0, 0.0, 1.0, 1.0), cap=40).collect()
    assert len(got) == 501 and all(r.tile_points < 40 or r.depth == 4 for r in got) and len({r.depth for r in got}) > 1
    small = T.adaptive_tiles(df.withColumns({"lat": F.col("lat") / 100, "lon": F.col("lon") / 100}), (0.0, 0.0, 0.01, 0.01), cap=40).collect()
    assert {r.depth for r in small} == {0}


def test_contact_links_and_page_facts(spark):
    html = ('<body><a href="/about-us">Who we are</a><a href="contact.html">Get in touch</a><a href="https://other.com/contact">x</a><a href=/files/contact.pdf>f</a>'
            "<a href='#contact'>Contact</a><a href='mailto:a@b.co'>team</a><a href='/blog'>News</a></body>")
    df = spark.createDataFrame([(1, "https://a.com/en/", html)], "page_id int, url string, html string")
    got = [(r.href, r.score) for r in N.contact_link_rank(df, 3).orderBy(F.col("score").desc(), "pos").collect()]
    assert got == [("https://a.com/about-us", 4), ("https://a.com/en/contact.html", 3), ("https://a.com/en/", 3)]


def test_page_budget_stops_when_satisfied(spark):
    rows = [(1, 0, 1, 0, 1), (1, 1, 0, 1, 1), (1, 2, 5, 5, 5), (2, 0, 0, 0, 0), (2, 1, 0, 0, 0), (2, 5, 0, 0, 0)]
    df = spark.createDataFrame(rows, "business_id int, ordinal int, n_emails int, n_phones int, n_socials int")
    assert sorted((r.business_id, r.ordinal) for r in N.page_budget(df).collect()) == [(1, 0), (1, 1), (2, 0), (2, 1)]


def test_a_poi_given_twice_is_one_row_as_last_seen(spark):
    old = spark.createDataFrame([("node/1", "Old", "old st")], "osm_key string, name string, street string")
    new = spark.createDataFrame([("node/1", "First", 1), ("node/1", "Last", 2), ("node/2", "B", 4), ("node/2", "A", 3), ("node/2", "B", 4)], "osm_key string, name string, seen int")
    got = P.upsert(old.withColumns({"first_seen_at": F.lit(None).cast("timestamp"), "last_seen_at": F.lit(None).cast("timestamp")}), new, "2024-01-30 12:00:00", [F.col("seen")])
    assert sorted((r.osm_key, r.name, r.is_new) for r in got.collect()) == [("node/1", "Last", False), ("node/2", "B", True)]
    assert P.upsert(old.withColumns({"first_seen_at": F.lit(None).cast("timestamp"), "last_seen_at": F.lit(None).cast("timestamp")}), new, "2024-01-30 12:00:00").count() == 2


def test_the_last_account_row_wins(spark):
    schema = "osm_key string, platform string, url string, handle string"
    old = spark.createDataFrame([("node/1", "facebook", "o.test", "h", "h", "known")], schema + ", handle_normalized string, followers_state string")
    new = spark.createDataFrame([("node/1", "facebook", "b.test", "h", 1), ("node/1", "facebook", "a.test", "h", 2)], schema + ", seen int")
    (row,) = P.upsert_socials(old, new, order=[F.col("seen")]).collect()
    assert (row.url, row.handle, row.followers_state) == ("a.test", "h", "known")


def test_a_long_streak_and_a_long_robots_file(spark):
    days = spark.sql("SELECT date_sub(DATE'2024-01-30', CAST(id AS INT)) AS day, 1L AS tasks_done FROM range(500)")
    assert S.streak(days, "2024-01-30").first().n == 500
    body = "user-agent: *\n" + "# filler\n" * 80000 + "disallow: /late\nallow: /late/ok*\n"
    rules = R.robots_rules(spark.createDataFrame([("a.test", body)], "domain string, body string"))
    urls = spark.createDataFrame([(1, "a.test", "/late/x"), (2, "a.test", "/late/okay"), (3, "a.test", "/")], "id int, domain string, path string")
    assert {r.id: r.allowed for r in R.robots_decision(urls, rules, "bot").collect()} == {1: False, 2: True, 3: True}
