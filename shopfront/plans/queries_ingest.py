"""Map data to businesses, tiles, runs, robots and places."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import urls as U
from ..operators import poi as P
from ..operators import robots as R
from ..operators import stats as S
from ..operators import tiles as TL
from ..operators.discovery import Store, discover
from ..operators.workspace import Workspace
from ..sources import tables as T
from . import oracle_tables as O
from .fixtures import NOW
from .registry import query

micros = lambda c: F.unix_micros(F.col(c)).alias(c)
join = lambda c, sep="|": F.array_join(c, sep)


def pois(t):
    return P.elements(t.poi_doc)


def normalized(t):
    return P.normalize(pois(t))


# ----------------------------------------------------------------- sources
@query("A1_poi_source", """SELECT type, id, CASE WHEN type = 'node' THEN lat END AS lat, CASE WHEN type <> 'node' THEN lon END AS center_lon,
  t_phone AS phone, tag_value, '2024-01-' || lpad((1 + id % 28)::VARCHAR, 2, '0') || 'T00:00:00Z' AS osm_base FROM fx_poi_cols
  UNION ALL SELECT 'node', -(id + 1), NULL, NULL, NULL, NULL, '2024-01-' || lpad((1 + id % 28)::VARCHAR, 2, '0') || 'T00:00:00Z' FROM fx_poi_cols""")
def _(t):
    keys = ["amenity", "shop", "craft", "tourism", "office", "leisure", "healthcare"]
    return pois(t).select("type", "id", "lat", F.col("center.lon").alias("center_lon"), P.tag("phone").alias("phone"),
                          F.coalesce(*(P.tag(k) for k in keys)).alias("tag_value"), "osm_base")


@query("A2_response_triage", """SELECT id, kind AS failure_kind, kind = 'ok' AS ok, n FROM (SELECT *, CASE WHEN trim(body) = '' THEN 'unavailable'
  WHEN body LIKE '<%' THEN CASE WHEN regexp_matches(body, '(?i)OSM3S Response|Overpass API') AND regexp_matches(body, '(?i)query timed out|query run out|out of memory')
    THEN 'server_timeout' WHEN status BETWEEN 400 AND 499 THEN 'bad_request' ELSE 'unavailable' END
  WHEN NOT json_valid(body) OR body NOT LIKE '%"elements":[%' THEN 'bad_request'
  WHEN body LIKE '%runtime error%' THEN 'server_timeout' WHEN status >= 500 THEN 'unavailable' WHEN status >= 400 THEN 'bad_request' ELSE 'ok' END AS kind,
  CASE WHEN json_valid(body) AND body LIKE '%"elements":[%' THEN json_array_length(body, '$.elements')::BIGINT ELSE 0 END AS n FROM fx_body)""")
def _(t):
    return P.triage(t.body).select("id", "failure_kind", "ok", "n")


@query("A5_activity_source", """SELECT id, kind, business_id, day::VARCHAR AS day, json_extract_string(meta, '$.toStage') AS to_stage FROM fx_activity""")
def _(t):
    saved = Workspace(t.spark, "activity-log")
    saved.written(t.activity.withColumn("at", F.col("at").cast("timestamp")), "log")
    df = T.read_activity(t.spark, f"{saved.path}/log")
    return df.select("id", "kind", "business_id", F.col("day").cast("string").alias("day"), F.get_json_object("meta", "$.toStage").alias("to_stage"))


@query("A8_dimensions", "SELECT p.preset, p.site_state, p.points::BIGINT AS points, s.label, count(b.id) AS n FROM " + O.values("site_points").replace(" AS site_points", " AS p")
       + " JOIN " + O.values("site_state").replace(" AS site_state(", " AS s(") + " USING (site_state) LEFT JOIN fx_business b USING (site_state) GROUP BY ALL")
def _(t):
    table = lambda n: F.broadcast(dims.dim(t.spark, n))
    counts = t.business.groupBy("site_state").agg(F.count("*").alias("n"))
    df = dims.dim(t.spark, "site_points").join(table("site_state"), "site_state").join(counts, "site_state", "left")
    return df.select("preset", "site_state", F.col("points").cast("bigint").alias("points"), "label", F.coalesce("n", F.lit(0)).alias("n"))


@query("A9_geocode_join", r"""SELECT request_id, k AS location_key, g.country_code, b0 AS south, b2 AS west, b1 AS north, b3 AS east,
  CASE WHEN osm_type = 'relation' THEN 3600000000 + osm_id END AS area_id FROM (SELECT request_id,
    regexp_replace(lower(trim(location_text)), '\s+', ' ', 'g') AS k FROM fx_place_request) r
  LEFT JOIN (SELECT * FROM fx_geocode WHERE fetch_state = 'ok') g ON g.location_key = r.k""")
def _(t):
    return T.geocode_join(t.place_request, t.geocode).select("request_id", "location_key", "country_code", "south", "west", "north", "east", "area_id")


@query("A10_robots_state", """SELECT domain, CASE WHEN status IS NULL OR status >= 500 THEN 'unreachable' WHEN status BETWEEN 200 AND 299 THEN 'ok'
  ELSE 'missing' END AS state, status IS NULL OR status >= 500 AS disallow_all FROM fx_robots""")
def _(t):
    return R.robots_state(t.robots).select("domain", "state", "disallow_all")


# ------------------------------------------------------------- projections
@query("B1_poi_named", "SELECT type || '/' || id AS osm_key, trim(t_name) AS name FROM fx_poi_cols WHERE coalesce(trim(t_name), '') <> ''")
def _(t):
    return P.named(pois(t)).select(P.osm_key().alias("osm_key"), F.trim(P.tag("name")).alias("name"))


@query("B2_poi_alive", f"""SELECT id, type FROM fx_poi_cols WHERE {O.ALIVE.split(' AND ', 1)[1]} UNION ALL SELECT -(id + 1), 'node' FROM fx_poi_cols""")
def _(t):
    return P.alive(pois(t)).select("id", "type")


@query("B3_poi_latlon", "SELECT id, lat, lon FROM fx_poi_cols UNION ALL SELECT -(id + 1), NULL, NULL FROM fx_poi_cols")
def _(t):
    return P.located(pois(t)).select("id", "lat", "lon")


@query("B4_multi_value", f"SELECT id, array_to_string({O.multi('t_phone')}, '|') AS phones, len({O.multi('t_email')}) AS n_emails FROM fx_poi_cols")
def _(t):
    df = t.poi_cols
    return df.select("id", join(P.multi_value(F.col("t_phone"))).alias("phones"), F.size(P.multi_value(F.col("t_email"))).cast("bigint").alias("n_emails"))


@query("B5_first_tag", "SELECT id, coalesce(nullif(trim(t_city), ''), nullif(trim(t_town), ''), nullif(trim(t_village), '')) AS place FROM fx_poi_cols UNION ALL SELECT -(id + 1), NULL FROM fx_poi_cols")
def _(t):
    return pois(t).select("id", P.first_tag(["addr:city", "addr:town", "addr:village"]).alias("place"))


@query("B6_poi_contacts", "SELECT osm_key, array_to_string(phones, '|') AS phones, array_to_string(emails, '|') AS emails FROM or_poi")
def _(t):
    return normalized(t).select("osm_key", join("phones").alias("phones"), join("emails").alias("emails"))


@query("B7_poi_socials", "SELECT * FROM or_poi_social")
def _(t):
    return P.socials(P.alive(P.named(pois(t))))


@query("B8_poi_category", "SELECT osm_key, category, category_label FROM or_poi")
def _(t):
    return normalized(t).select("osm_key", "category", "category_label")


@query("B9_poi_address", "SELECT osm_key, address_line, street, house_number, city, country_code, postcode FROM or_poi")
def _(t):
    return normalized(t).select("osm_key", "address_line", "street", "house_number", "city", "country_code", "postcode")


@query("B10_initial_site_state", "SELECT osm_key, site_state, website_url, website_domain, dedupe_key FROM or_poi")
def _(t):
    return normalized(t).select("osm_key", "site_state", "website_url", "website_domain", "dedupe_key")


_cats = "SELECT DISTINCT category, label FROM " + O.values("category_selector")


@query("B11_category_scope", f"""SELECT 'some' AS asked, category, count(b.id) AS n FROM ({_cats}) c LEFT JOIN fx_business b USING (category)
  WHERE category IN ('auto', 'retail') GROUP BY ALL UNION ALL SELECT 'none', category, count(b.id) FROM ({_cats}) c LEFT JOIN fx_business b USING (category) GROUP BY ALL""")
def _(t):
    counts = t.business.groupBy("category").agg(F.count("*").alias("n"))
    cats = dims.dim(t.spark, "category_selector").select("category").distinct()
    scoped = lambda name, keys: P.scoped_categories(cats, keys).select(F.lit(name).alias("asked"), "category")
    df = scoped("some", ["retail", "auto", "nope"]).unionByName(scoped("none", ["nope"]))
    return df.join(counts, "category", "left").select("asked", "category", F.coalesce("n", F.lit(0)).alias("n"))


@query("B12_merged_selectors", "SELECT tag_key, string_agg(tag_value, '|' ORDER BY cat_ord, sel_ord, pos) AS tag_values, any_value(n_pois) AS n_pois FROM ("
       "SELECT tag_key, tag_value, cat_ord, sel_ord, pos FROM (SELECT *, row_number() OVER () AS pos FROM " + O.values("category_selector") + ")"
       " QUALIFY row_number() OVER (PARTITION BY tag_key, tag_value ORDER BY cat_ord, sel_ord, pos) = 1) s"
       " JOIN (SELECT tag_key, count(*) AS n_pois FROM fx_poi_cols GROUP BY tag_key) p USING (tag_key) GROUP BY tag_key")
def _(t):
    sel = dims.dim(t.spark, "category_selector").withColumn("pos", F.monotonically_increasing_id())
    counts = t.poi_cols.groupBy("tag_key").agg(F.count("*").alias("n_pois"))
    return P.merged_selectors(sel).join(counts, "tag_key").select("tag_key", join("tag_values").alias("tag_values"), "n_pois")


BOX = (51.0, -2.0, 51.05, -1.996)


@query("B13_poi_scan", f"""SELECT type || '/' || id AS osm_key FROM fx_poi_cols WHERE t_name IS NOT NULL AND regexp_matches(t_name, '(?i)customer.*cafe')
  AND lat BETWEEN 51.0 AND 51.05 AND lon BETWEEN -2.0 AND -1.996 AND ((tag_key = 'shop' AND tag_value IN {O.rlist(dims.CATEGORIES[3][2][0][1])})
    OR (tag_key = 'leisure' AND tag_value = 'spa') OR (tag_key = 'tourism' AND tag_value = 'hotel'))""")
def _(t):
    return P.scan(pois(t), ["retail", "hospitality"], BOX, 'customer.*"cafe').select("osm_key")


# ----------------------------------------------------------------- upserts
@query("H1_poi_upsert", """SELECT coalesce(n.osm_key, o.osm_key) AS osm_key, coalesce(n.name, o.name) AS name, coalesce(n.category, o.category) AS category,
  coalesce(n.city, o.city) AS city, coalesce(n.address_line, o.address_line) AS address_line, coalesce(n.country_code, o.country_code) AS country_code,
  CASE WHEN o.osm_key IS NOT NULL THEN o.street ELSE n.street END AS street, CASE WHEN o.osm_key IS NOT NULL THEN o.website_url ELSE n.website_url END AS website_url,
  CASE WHEN o.osm_key IS NOT NULL THEN o.dedupe_key ELSE n.dedupe_key END AS dedupe_key, CASE WHEN o.osm_key IS NOT NULL THEN o.site_state ELSE n.site_state END AS site_state,
  o.osm_key IS NULL AS is_new, epoch_us(CASE WHEN o.osm_key IS NULL THEN TIMESTAMP '2024-01-30 12:00:00' ELSE o.first_seen_at END) AS first_seen_at
  FROM fx_business o FULL JOIN or_poi n ON n.osm_key = o.osm_key""")
def _(t):
    df = P.upsert(t.business, normalized(t), NOW)
    return df.select("osm_key", "name", "category", "city", "address_line", "country_code", "street", "website_url", "dedupe_key", "site_state", "is_new", micros("first_seen_at"))


@query("H2_phone_insert", """SELECT osm_key, raw, e164, confidence, reject_reason FROM or_poi_phone WHERE e164 IS NULL
  UNION ALL SELECT osm_key, raw, e164, confidence, reject_reason FROM (SELECT * FROM or_poi_phone
  WHERE (osm_key, coalesce(e164, raw)) NOT IN (SELECT (osm_key, raw) FROM or_poi_phone WHERE e164 IS NULL)
  QUALIFY row_number() OVER (PARTITION BY osm_key, coalesce(e164, raw) ORDER BY ord) = 1)""")
def _(t):
    # parsed once: the inserts read the rows seven times, and test columns that are computed at length
    incoming = Workspace(t.spark, "phone-insert").written(P.poi_phones(normalized(t)), "phones")
    # the unresolved ones are known already
    first = P.insert_phones(incoming.filter("e164 IS NULL"), incoming)
    again = P.insert_phones(first, incoming)
    return again.select("osm_key", "raw", "e164", "confidence", "reject_reason")


@query("H3_email_insert", """SELECT osm_key, lower(e) AS address, lower(split_part(e, '@', 2)) AS domain, 'role' AS kind, 60::BIGINT AS confidence
  FROM (SELECT osm_key, unnest(emails) AS e FROM or_poi)""")
def _(t):
    incoming = P.poi_emails(normalized(t))
    known = incoming.filter("address LIKE 'info@%'")
    return P.insert_emails(known, incoming).select("osm_key", "address", "domain", "kind", "confidence")


@query("H4_social_upsert", """SELECT osm_key, platform, hn AS handle_normalized, max(url) AS url, max(handle) AS handle, max(state) AS followers_state FROM (
  SELECT *, coalesce(handle, lower(url)) AS hn FROM (SELECT *, CASE WHEN platform = 'twitter' THEN 'known' ELSE 'not_attempted' END AS state FROM or_poi_social
  UNION ALL SELECT osm_key, n_platform, n_url, n_handle, 'not_attempted' FROM or_poi WHERE n_url IS NOT NULL AND n_platform IS NOT NULL))
  GROUP BY 1, 2, 3""")
def _(t):
    new = P.all_socials(normalized(t))
    old = P.socials(P.alive(P.named(pois(t)))).filter("platform = 'twitter'").select(
        "osm_key", "platform", F.concat(F.lit("old "), "url").alias("url"), "handle", F.coalesce("handle", F.lower("url")).alias("handle_normalized"),
        F.lit("known").alias("followers_state"))
    return P.upsert_socials(old, new)


@query("J5_normalize_name", f"SELECT id, {O.NAME.format('t_name')} AS name, {O.NAME.format(chr(39) + 'Café Rémy ' + chr(39) + ' || t_name')} AS accented FROM fx_poi_cols")
def _(t):
    return t.poi_cols.select("id", U.normalize_name(F.col("t_name")).alias("name"),
                             U.normalize_name(F.concat(F.lit("Café Rémy "), "t_name")).alias("accented"))


# ------------------------------------------------------------------- tiles
_box = (50.0, -2.0, 51.0, -1.0)
_tile = lambda d, c, low: f"(least(15, greatest(0, floor(({c} - ({low})) / (1.0::DOUBLE / 16))))::BIGINT >> {4 - d})"


def _tiles(cap: int) -> str:
    per = " UNION ALL ".join(f"SELECT point_id, {d} AS depth, {_tile(d, 'lat', 50)} AS cell_y, {_tile(d, 'lon', -2)} AS cell_x FROM fx_points" for d in range(5))
    return f"""SELECT point_id, depth::BIGINT AS depth, cell_y, cell_x, tile_points FROM (SELECT *, count(*) OVER (PARTITION BY depth, cell_y, cell_x) AS tile_points
      FROM ({per})) WHERE tile_points < {cap} OR depth = 4 QUALIFY rank() OVER (PARTITION BY point_id ORDER BY depth) = 1"""


@query("L1_adaptive_tiles", _tiles(200))
def _(t):
    df = TL.adaptive_tiles(t.points, _box, cap=200)
    return df.select("point_id", *(F.col(c).cast("bigint").alias(c) for c in ("depth", "cell_y", "cell_x")), "tile_points")


@query("L2_tile_dedupe", "SELECT osm_key, min(hit_id) AS hit_id, arg_min(query_id, hit_id) AS query_id FROM fx_hit GROUP BY osm_key")
def _(t):
    return P.dedupe_hits(t.hit).select("osm_key", "hit_id", "query_id")


@query("L3_coverage_check", """SELECT source, count(*) AS tiles, sum(n_empty)::BIGINT AS n_empty FROM (SELECT a.tile, a.source, count(*) FILTER (WHERE n_elements = 0) AS n_empty
  FROM fx_response a WHERE ok GROUP BY 1, 2) e WHERE n_empty > 0 AND EXISTS (SELECT 1 FROM fx_response b WHERE b.ok AND b.tile = e.tile AND b.source <> e.source
  AND b.n_elements > 0) GROUP BY source""")
def _(t):
    return TL.coverage_check(t.response)


@query("L4_area_fallback", """SELECT query_id, hit_id, used_area FROM (SELECT query_id, hit_id, true AS used_area FROM fx_hit WHERE query_id % 3 = 0 AND tile_index < 8
  UNION ALL SELECT query_id, hit_id, false FROM fx_hit h WHERE NOT EXISTS (SELECT 1 FROM fx_hit a WHERE a.query_id = h.query_id AND a.query_id % 3 = 0 AND a.tile_index < 8))
  WHERE query_id IN (SELECT user_id FROM events)""")
def _(t):
    hits = t.hit.select("query_id", "hit_id", "tile_index")
    runs = t.run.select(F.col("id").alias("query_id"))
    area = hits.filter("query_id % 3 = 0 AND tile_index < 8")
    return TL.area_fallback(runs, area, hits).select("query_id", "hit_id", "used_area")


# ------------------------------------------------------------ runs and logs
@query("C3_discovery_enrichment", """SELECT query_id, count(*) FILTER (WHERE enrichment_state = 'pending') AS queued, count(*) FILTER (WHERE enrichment_state = 'running') AS running,
  count(*) FILTER (WHERE enrichment_stage = 'done') AS done, count(*) FILTER (WHERE enrichment_state = 'failed') AS failed
  FROM (SELECT DISTINCT query_id, business_id FROM fx_hit) l JOIN fx_business b ON b.id = l.business_id GROUP BY query_id""")
def _(t):
    return S.discovery_enrichment(t.business, t.hit.select("query_id", "business_id").distinct())


def sqlstr(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


@query("D10_run_summary", f"""SELECT r.id, count(x.query_id) AS tiles_total, count(*) FILTER (WHERE x.status <> 'pending') AS tiles_done,
  count(*) FILTER (WHERE x.status = 'failed') AS tiles_failed, coalesce(sum(n_pois), 0)::BIGINT AS pois_found,
  CASE WHEN coalesce(sum(n_pois), 0) > 0 THEN 'done' WHEN aborted OR count(*) FILTER (WHERE x.status = 'failed') > 0 THEN 'error' ELSE 'empty' END AS status,
  CASE WHEN aborted THEN {sqlstr(dims.RUN_ABORTED)} WHEN count(*) FILTER (WHERE x.status = 'failed') > 0 THEN count(*) FILTER (WHERE x.status = 'failed') || ' of ' || count(x.query_id)
    || ' area' || CASE WHEN count(x.query_id) = 1 THEN '' ELSE 's' END
    || ' could not be fetched from any mirror — results are partial. Try again in a few minutes.' END AS note
  FROM fx_run r LEFT JOIN fx_tile x ON x.query_id = r.id GROUP BY r.id, aborted""")
def _(t):
    return S.run_summary(t.run, t.tile)


@query("D11_source_health", """SELECT source, count(*) FILTER (WHERE ok) AS ok_count, count(*) FILTER (WHERE NOT ok AND (ts, id) > coalesce(last_ok, (TIMESTAMP '1900-01-01', 0))) AS failures,
  arg_max(error, (ts, id)) FILTER (WHERE NOT ok AND (ts, id) > last_ok) AS last_error, arg_max(n_elements, (ts, id)) FILTER (WHERE ok) AS last_n_elements,
  list_reduce(list(ms ORDER BY ts, id) FILTER (WHERE ok), lambda x, y: ((7 * x + 3 * y + 5) // 10)) AS avg_ms,
  CASE WHEN count(*) FILTER (WHERE NOT ok AND (ts, id) > last_ok) > 0 THEN least(30, 5 * count(*) FILTER (WHERE NOT ok AND (ts, id) > last_ok)) ELSE 0 END AS cooldown_min
  FROM fx_response JOIN (SELECT source, max((ts, id)) FILTER (WHERE ok) AS last_ok FROM fx_response GROUP BY source) USING (source) GROUP BY source""")
def _(t):
    return S.source_health(t.response).select("source", "ok_count", "failures", "last_error", "last_n_elements", "avg_ms", "cooldown_min")


@query("D12_latest_map_date", "SELECT arg_max(osm_base, id) AS osm_base FROM fx_run WHERE osm_base IS NOT NULL")
def _(t):
    return S.latest_map_date(t.run)


@query("D15_run_poi_links", "SELECT query_id, count(DISTINCT osm_key) AS n FROM fx_hit GROUP BY query_id")
def _(t):
    return P.run_poi_links(t.hit)


_tail = """SELECT domain, count(*) FILTER (WHERE ok) AS ok_count, count(*) FILTER (WHERE NOT ok AND (last_ok IS NULL OR (fetched_at, id) > last_ok)) AS failures,
  max(fetched_at) FILTER (WHERE NOT ok AND (last_ok IS NULL OR (fetched_at, id) > last_ok)) AS last_failure_at FROM
  (SELECT *, coalesce(status BETWEEN 200 AND 399, false) AS ok FROM fx_fetch) JOIN
  (SELECT domain, max((fetched_at, id)) FILTER (WHERE coalesce(status BETWEEN 200 AND 399, false)) AS last_ok FROM fx_fetch GROUP BY domain) USING (domain) GROUP BY domain"""


@query("D17_domain_health", f"""SELECT domain, ok_count, failures, coalesce(failures >= 5 AND last_failure_at + INTERVAL 30 MINUTE > TIMESTAMP '2024-01-30 12:00:00', false) AS unhealthy
  FROM ({_tail})""")
def _(t):
    log = t.fetch.select("id", F.col("fetched_at").alias("ts"), "domain", F.coalesce(F.col("status").between(200, 399), F.lit(False)).alias("ok"), "error")
    return S.domain_health(log, NOW).select("domain", "ok_count", "failures", "unhealthy")


@query("E10_latest_runs", "SELECT id FROM fx_run ORDER BY created_at DESC, id DESC LIMIT 25")
def _(t):
    return S.latest_runs(t.run).select("id")


_health = """SELECT source, count(*) FILTER (WHERE ok) AS ok_count, count(*) FILTER (WHERE NOT ok AND (ts, id) > last_ok) AS failures,
  max(ts) FILTER (WHERE NOT ok AND (ts, id) > last_ok) AS last_failure_at, list_reduce(list(ms ORDER BY ts, id) FILTER (WHERE ok), lambda x, y: ((7 * x + 3 * y + 5) // 10)) AS avg_ms
  FROM fx_response JOIN (SELECT source, max((ts, id)) FILTER (WHERE ok) AS last_ok FROM fx_response GROUP BY source) USING (source) GROUP BY source"""


@query("E11_source_rank", f"""SELECT source, row_number() OVER (ORDER BY failures, ok_count DESC, avg_ms, source) AS rank FROM (SELECT *,
  failures = 0 OR last_failure_at + INTERVAL 1 MINUTE * least(30, 5 * failures) < TIMESTAMP '2024-01-30 12:00:00' AS healthy FROM ({_health}))
  QUALIFY healthy OR NOT bool_or(healthy) OVER ()""")
def _(t):
    return S.source_rank(S.source_health(t.response), NOW).select("source", F.col("rank").cast("bigint").alias("rank"))


# ------------------------------------------------------------------ robots
TOKEN = "shopfrontbot"
RULES = r"""SELECT domain, line, CASE WHEN field = 'sitemap' THEN 0 ELSE grp END AS grp, CASE WHEN field = 'sitemap' THEN CASE WHEN value <> '' THEN 'sitemap' END WHEN grp = 0 THEN NULL
    WHEN field = 'user-agent' THEN CASE WHEN value <> '' THEN 'agent' END WHEN field = 'allow' THEN 'allow' WHEN field = 'disallow' THEN CASE WHEN value <> '' THEN 'disallow' END
    WHEN field = 'crawl-delay' THEN CASE WHEN try_cast(value AS DOUBLE) >= 0 THEN 'delay' END END AS kind, CASE WHEN field = 'user-agent' THEN lower(value) ELSE value END AS value,
  CASE WHEN field = 'crawl-delay' THEN floor(try_cast(value AS DOUBLE) * 1000 + 0.5)::BIGINT END AS delay_ms
  FROM (SELECT *, (sum(CASE WHEN field = 'user-agent' AND coalesce(prev, '') <> 'user-agent' THEN 1 ELSE 0 END) OVER (PARTITION BY domain ORDER BY line))::BIGINT AS grp FROM (
    SELECT *, lag(field) OVER (PARTITION BY domain ORDER BY line) AS prev FROM (
      SELECT domain, line, lower(trim(split_part(txt, ':', 1))) AS field, trim(substr(txt, strpos(txt, ':') + 1)) AS value FROM (
        SELECT domain, generate_subscripts(ls, 1) - 1 AS line, trim(split_part(unnest(ls), '#', 1)) AS txt FROM (SELECT domain, string_split(body, chr(10)) AS ls FROM {src}))
      WHERE contains(txt, ':'))))"""


@query("A7_robots_rules", "SELECT * FROM (" + RULES.format(src="fx_robots") + ") WHERE kind IS NOT NULL")
def _(t):
    return R.robots_rules(t.robots).withColumn("line", F.col("line").cast("bigint"))


_okrules = "(SELECT * FROM (" + RULES.format(src="(SELECT * FROM fx_robots WHERE status BETWEEN 200 AND 299)") + ") WHERE kind IS NOT NULL)"
_applied = f"""(WITH r AS MATERIALIZED {_okrules}, a AS (SELECT domain, grp, CASE WHEN value <> '*' AND (contains('{TOKEN}', value) OR contains(value, '{TOKEN}')) THEN length(value)
    WHEN value = '*' THEN 0 END AS rk FROM r WHERE kind = 'agent'), g AS (SELECT DISTINCT domain, grp FROM a WHERE rk IS NOT NULL
    QUALIFY rk = max(rk) OVER (PARTITION BY domain)) SELECT r.* FROM r JOIN g USING (domain, grp))"""
_re = r"""'^' || replace(regexp_replace(CASE WHEN ends_with(value, '$') THEN value[:-2] ELSE value END, '([.+?^${}()|\[\]\\])', '\\\1', 'g'), '*', '.*') || CASE WHEN ends_with(value, '$') THEN '$' ELSE '' END"""
_path = "CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+([^#]*)', 1) END"
_decided = rf"""SELECT p.page_id, coalesce(w.kind = 'allow', true) AS allowed, w.value AS rule, d.delay_ms FROM fx_page p LEFT JOIN (
    SELECT p.page_id, x.kind, x.value FROM fx_page p JOIN {_applied} x ON x.domain = p.host AND x.kind IN ('allow', 'disallow') AND x.value <> '' AND regexp_matches({_path}, {_re})
    QUALIFY row_number() OVER (PARTITION BY p.page_id ORDER BY length(regexp_replace(x.value, '[*$]', '', 'g')) DESC, x.kind, CASE WHEN x.kind = 'allow' THEN -x.line ELSE x.line END) = 1) w USING (page_id)
  LEFT JOIN (SELECT domain, arg_min(delay_ms, (grp, -line)) AS delay_ms FROM {_applied} WHERE kind = 'delay' GROUP BY domain) d ON d.domain = p.host"""


def frontier(t):
    return t.page.select("page_id", F.col("host").alias("domain"), F.regexp_extract("url", "^https?://[^/?#]+([^#]*)", 1).alias("path"))


@query("E6_robots_decision", _decided)
def _(t):
    rules = R.robots_rules(t.robots.filter("status BETWEEN 200 AND 299"))
    return R.robots_decision(frontier(t), rules, TOKEN).select("page_id", "allowed", "rule", "delay_ms")


@query("C9_frontier_robots", f"""SELECT x.page_id, allowed AND NOT closed AS allowed, CASE WHEN closed THEN 'unavailable' ELSE rule END AS rule,
  CASE WHEN NOT closed THEN delay_ms END AS delay_ms FROM ({_decided}) x JOIN (SELECT page_id, coalesce(r.status >= 500 OR (r.domain IS NOT NULL AND r.status IS NULL), false) AS closed
  FROM fx_page p LEFT JOIN fx_robots r ON r.domain = p.host) c USING (page_id)""")
def _(t):
    return R.frontier_robots(frontier(t), t.robots, TOKEN).select("page_id", "allowed", "rule", "delay_ms")


@query("J19_sitemap_urls", r"""SELECT page_id, array_to_string(list_filter(list_transform(regexp_extract_all(xml, '(?i)<loc>\s*([^<\s]+)\s*</loc>', 1), lambda u: replace(u, '&amp;', '&')),
  lambda u: regexp_matches(u, '(?i)^https?://')), '|') AS urls FROM fx_sitemap""")
def _(t):
    return t.sitemap.select("page_id", join(R.sitemap_urls(F.col("xml"))).alias("urls"))


# ---------------------------------------------------------- discovery as a whole
def discovery_batches(t):
    """Two runs of saved documents with their countries: the second meets some of the businesses of the first."""
    saved = Workspace(t.spark, "documents")
    run = lambda docs, q: saved.written(docs, f"run-{q}").select("doc_id", "status", "body", F.lit(q).alias("query_id"), F.when(F.col("doc_id") % 2 == 0, "gb").alias("country_hint"))
    return [(run(t.poi_doc, 1), "2024-01-30 12:00:00"), (run(t.poi_doc_2, 2), "2024-01-31 12:00:00")]


@query("X2_discovery")
def _(t):
    store = Store(t.spark, Workspace(t.spark, "discovery-store").path, 16)
    for docs, now in discovery_batches(t):
        discover(docs, store, now)
    runs = store.links.read().groupBy("osm_key").agg(F.count("*").alias("n_runs"))
    return store.leads.read().join(runs, "osm_key").select("osm_key", "name", "category", "site_state", "website_url", "has_phone", "has_email", "has_social", "email", "phone_e164", "score", micros("first_seen_at"), "n_runs")
