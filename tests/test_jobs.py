"""The joined-up jobs against plain loops."""
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shopfront import dims
from shopfront.operators import enrichment as E
from shopfront.operators import site_enrichment as SE
from shopfront.plans import queries_contacts
from shopfront.plans.registry import Inputs, load

load()
SF = "/root/testdata/sf0.001"
SITES = "/root/testdata/sf0.01"


# ------------------------------------------------------------------ sites
@pytest.fixture(scope="module")
def site_run(spark):
    tables = queries_contacts.site_tables(Inputs(spark, SITES))
    return tables, SE.enrich_sites(**tables)


def plain_sites(spark, tables, budget=4):
    """One site after the other, one page after the other; pages are parsed by the table jobs, each on its own."""
    pages = SE.U.cache_key(tables["pages"], "url", "url_key")
    seen = {}
    for r in pages.select("url_key", "page_id", "url", "fetched_at", "status", "content_type", "html", "robots_blocked").collect():
        if r.url_key not in seen or (r.fetched_at, r.page_id) > (seen[r.url_key].fetched_at, seen[r.url_key].page_id):
            seen[r.url_key] = r
    by_page = lambda df: {k: list(v) for k, v in _grouped(df).items()}
    with_country = pages.withColumn("country_code", F.explode(F.array(F.lit("gb"), F.lit(None), F.lit("de"))))
    emails = by_page(E.email_extract_job(pages))
    socials = by_page(E.social_extract_job(pages))
    phones = {}
    for country in ("gb", None, "de"):
        phones[country] = by_page(E.phone_extract_job(pages.withColumn("country_code", F.lit(country).cast("string"))))
    links = by_page(E.contact_link_rank(pages, budget))
    xml = {r.url: re.findall("<loc>(.*?)</loc>", r.xml) for r in tables["sitemaps"].collect()}
    robots = {r.domain: r for r in tables["robots"].collect()}
    key_of = lambda urls: {r.url: r.k for r in SE.U.cache_key(spark.createDataFrame([(u,) for u in urls], "url string"), "url", "k").collect()}
    leads = {r.id: r for r in tables["leads"].collect()}
    state = {r.id: r.site_state for r in E.site_probe_job(SE.U.cache_key(tables["leads"], "website_url", "url_key"), pages, tables["socials"]).collect()}

    def closed(url):
        host, path = re.match(r"https?://(?:www\.)?([^/?#:]+)[^/?#]*([^#]*)", url).groups()
        r = robots.get(host) or robots.get("www." + host)
        if r is None or r.status != 200:
            return False
        return any(path.startswith(rule) for rule in re.findall(r"Disallow: (\S+)", r.body))

    plans = {}
    for i, lead in leads.items():
        if lead.website_url and state[i] in dims.SCRAPEABLE_STATES:
            origin = re.match(r"https?://[^/?#]+", lead.website_url).group()
            host = re.match(r"https?://(?:www\.)?([^/?#:]+)", origin).group(1)
            file = robots.get(host) or robots.get("www." + host)
            named = re.search(r"Sitemap: (\S+)", file.body) if file is not None and file.status == 200 else None
            maps = xml.get(named.group(1), []) if named else []
            plans[i] = (lead.website_url, origin, [u for u in maps if re.search(dims.SITEMAP_WORDS, u)][:2])
    keys = key_of({lead.website_url for lead in leads.values() if lead.website_url} | {o + g for _, o, _ in plans.values() for g in dims.CONTACT_GUESSES}
                  | {u for _, _, m in plans.values() for u in m} | {r[1] for v in links.values() for r in v})
    out = {}
    for i, (home, origin, maps) in plans.items():
        visits, found = [], {"e": 0, "p": 0, "s": 0}
        kept = {"e": {}, "p": {}, "s": {}}
        happy = lambda: found["e"] > 0 and found["p"] > 0 and found["s"] >= 2

        def visit(url):
            if url in [v[0] for v in visits] or len(visits) > budget:
                return
            page = None if closed(url) else seen.get(keys[url])
            visits.append((url, page and page.page_id))
            if page is None or page.robots_blocked or not page.html or page.status is None or not 200 <= page.status < 300 or not re.search(E.HTML_TYPES, page.content_type):
                return
            for r in emails.get(page.page_id, []):
                found["e"] += 1
                kept["e"].setdefault(r.address, r.confidence)
            for r in phones[leads[i].country_code].get(page.page_id, []):
                found["p"] += r.reject_reason is None
                kept["p"].setdefault(r.e164 or r.raw, r.confidence)
            for r in socials.get(page.page_id, []):
                found["s"] += 1
                kept["s"][r.platform, r.handle or r.url.lower()] = r.url

        visit(home)
        page = None if closed(home) else seen.get(keys[home])
        followed = 0
        if not happy() and page is not None and not page.robots_blocked and page.status and 200 <= page.status < 300 and re.search(E.HTML_TYPES, page.content_type):
            for r in sorted(links.get(page.page_id, []), key=lambda r: (-r.score, r.pos)):
                if happy() or followed >= budget:
                    break
                followed += 1
                visit(r.href)
        for guess in dims.CONTACT_GUESSES:
            if happy() or followed >= budget:
                break
            followed += 1
            visit(origin + guess)
        for url in maps:
            if happy():
                break
            visit(url)
        out[i] = (visits, kept)
    return state, out


def _grouped(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.page_id].append(r)
    return out


def test_sites_like_a_plain_loop(spark, site_run):
    tables, got = site_run
    state, want = plain_sites(spark, tables)
    visits = defaultdict(list)
    for r in got["visits"].orderBy("business_id", "ordinal").collect():
        visits[r.business_id].append((r.url, r.page_id))
    assert visits == {i: v for i, (v, _) in want.items()}
    assert {r.id: r.site_state for r in got["leads"].collect()} == state
    known = {r.business_id: r for r in tables["emails"].collect()}
    emails = defaultdict(dict)
    for r in got["emails"].collect():
        emails[r.business_id][r.address] = (r.source, r.confidence)
    for i, (_, kept) in want.items():
        mine = {a: ("site", round(c * 100)) for a, c in kept["e"].items()}
        if i in known:
            mine[known[i].address] = ("osm", 60)
        assert emails[i] == mine
    phones = defaultdict(set)
    for r in got["phones"].filter("source = 'site'").collect():
        phones[r.business_id].add(r.e164 or r.raw)
    before = {r.business_id: r.e164 or r.raw for r in tables["phones"].collect()}
    assert phones == {i: s for i, (_, kept) in want.items() if (s := set(kept["p"]) - {before.get(i)})}
    accounts = {(r.business_id, r.platform, r.handle_normalized): r.url for r in got["socials"].collect()}
    old = {(r.business_id, r.platform, r.handle_normalized): r.url for r in tables["socials"].collect()}
    assert accounts == {**old, **{(i, *k): u for i, (_, kept) in want.items() for k, u in kept["s"].items()}}
    # the cases that matter are there: sites of several pages, sites that stop early, and pages closed by robots rules
    lengths = [sum(p is not None for _, p in v) for v, _ in want.values()]
    assert sum(n >= 2 for n in lengths) >= 5 and min(lengths) <= 1 and any(not r.allowed for r in got["visits"].collect())


def test_known_accounts_keep_their_counts(site_run):
    _, got = site_run
    rows = got["socials"].filter("followers = 7").collect()
    assert rows and all(r.followers_state == "known" for r in rows)


def test_sites_without_pages(spark, site_run):
    tables, _ = site_run
    empty = {**tables, "pages": tables["pages"].filter("false")}
    got = SE.enrich_sites(**empty)
    assert got["visits"].count() == 0
    assert {r.site_state for r in got["leads"].collect()} == {"has_tag_unprobed", "social_only", "no_tag"} - ({"no_tag"} if tables["leads"].filter("website_url IS NULL").join(tables["socials"], F.col("business_id") == tables["leads"]["id"], "left_anti").isEmpty() else set())


# ------------------------------------------------------------------ discovery
def whole_tables(spark, batches):
    """The same runs by full joins over whole tables, no folders."""
    from shopfront.operators import discovery as D
    from shopfront.operators import poi as P

    old = spark.createDataFrame([], D.SCHEMAS["businesses"])
    contacts = {"phones": {}, "emails": {}, "socials": {}}
    for docs, now in batches:
        pois = D.found(docs)
        old = P.upsert(old, pois, now, [F.col("doc_id"), F.col("pos")]).drop("is_new")
        rows = pois.select("osm_key", "doc_id", "pos", "phones", "emails", F.coalesce("country_hint", "country_code").alias("country_code"))
        for r in P.add_tag_phones(rows.drop("emails")).orderBy("doc_id", "pos", "ord").collect():
            contacts["phones"].setdefault((r.osm_key, r.e164 or r.raw), (now, r.raw, r.confidence))
        for r in P.add_tag_emails(rows.drop("phones")).orderBy("doc_id", "pos", "ord").collect():
            contacts["emails"].setdefault((r.osm_key, r.address), (now,))
        for r in P.all_socials(pois).collect():
            contacts["socials"][r.osm_key, r.platform, r.handle or r.url.lower()] = 1
    return old, contacts


def as_rows(df, columns):
    return sorted((tuple(sorted(r[c].items()) if isinstance(r[c], dict) else r[c] for c in columns) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def discovered(spark, tmp_path_factory):
    from shopfront.operators import discovery as D
    from shopfront.plans import queries_ingest

    batches = queries_ingest.discovery_batches(Inputs(spark, SF))
    path = str(tmp_path_factory.mktemp("store"))
    store = D.Store(spark, path, 8)
    return path, store, batches, [D.discover(docs, store, now).first() for docs, now in batches]


def test_discovery_like_full_joins(spark, discovered):
    from shopfront.operators import discovery as D

    _, store, batches, counts = discovered
    old, contacts = whole_tables(spark, batches)
    columns = spark.createDataFrame([], D.SCHEMAS["businesses"]).columns
    assert as_rows(store.businesses.read(), columns) == as_rows(old, columns)
    phones = {(r.osm_key, r.phone_key): (str(r.id.batch), r.raw, r.confidence) for r in store.phones.read().collect()}
    assert phones == contacts["phones"]
    assert {(r.osm_key, r.address): (str(r.id.batch),) for r in store.emails.read().collect()} == contacts["emails"]
    assert {(r.osm_key, r.platform, r.handle_normalized) for r in store.socials.read().collect()} == set(contacts["socials"])
    assert counts[0].new == counts[0].businesses > 0 and 0 < counts[1].new < counts[1].businesses
    leads = {r.osm_key: r for r in store.leads.read().collect()}
    assert len(leads) == store.businesses.read().count()
    for key, lead in leads.items():
        assert lead.has_email == any(k == key for k, _ in contacts["emails"]) and lead.has_phone == any(k == key and p.startswith("+") for k, p in contacts["phones"])


def folders_of(path, table):
    import os

    return {d: sorted(os.listdir(os.path.join(path, table, d))) for d in os.listdir(os.path.join(path, table)) if "=" in d}


def test_a_batch_rewrites_its_own_folders_only(spark, discovered):
    from shopfront.operators import discovery as D

    path, store, batches, _ = discovered
    before = {t: folders_of(path, t) for t in D.SCHEMAS}
    rows = {t: as_rows(getattr(store, t).read(), spark.createDataFrame([], D.SCHEMAS[t]).columns) for t in D.SCHEMAS}
    docs, now = batches[1]
    keys = D.found(docs).select("osm_key", "doc_id", store.businesses.folder().alias("f")).collect()
    one = keys[0].f
    # documents hold one business each
    only = docs.filter(F.col("doc_id").isin([r.doc_id for r in keys if r.f == one]))
    assert D.discover(only, store, now).first().folders == 1
    for t in D.SCHEMAS:
        after = folders_of(path, t)
        changed = {d for d in after if after[d] != before[t].get(d)}
        assert changed <= {f"osm_key_of_8={one}"}, t
        # the batch was there already: no row is another
        assert as_rows(getattr(store, t).read(), spark.createDataFrame([], D.SCHEMAS[t]).columns) == rows[t], t
    plan = store.businesses.read([one])._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*osm_key_of_8", plan)  # the other folders are not opened


def test_the_same_poi_twice_is_one_business(spark, tmp_path):
    from shopfront.operators import discovery as D

    body = '{"elements":[{"type":"node","id":4,"tags":{"name":"%s","shop":"bakery","phone":"%s"}}]}'
    docs = lambda *rows: spark.createDataFrame([(i, 200, body % (name, phone)) for i, name, phone in rows], "doc_id bigint, status int, body string")
    store = D.Store(spark, str(tmp_path), 4)
    first = D.discover(docs((1, "Rye", "+44 1373 123456"), (2, "Rye Bakery", "+44 1373 123457"), (3, "", "x")), store, "2024-01-01 00:00:00").first()
    again = D.discover(docs((9, "Rye Bakery", "+44 1373 123457")), store, "2024-01-02 00:00:00").first()
    assert (first.businesses, first.new, first.pois) == (1, 1, 2) and (again.businesses, again.new) == (1, 0)
    (row,) = store.businesses.read().collect()
    assert row.name == "Rye Bakery" and str(row.first_seen_at) == "2024-01-01 00:00:00" and str(row.last_seen_at) == "2024-01-02 00:00:00"
    assert sorted(r.e164 for r in store.phones.read().collect()) == ["+441373123456", "+441373123457"]
    (lead,) = store.leads.read().collect()
    assert lead.phone_e164 == "+441373123456"  # the first one seen
    nothing = D.discover(docs(), store, "2024-01-03 00:00:00").first()
    assert (nothing.documents, nothing.businesses, nothing.folders) == (0, 0, 0)
