"""Input tables the registered queries run on, derived from the given parquet tables.

Each fixture is one SELECT in the part of SQL that Spark and DuckDB share, so both
sides of a comparison start from the same rows. Every fixture reads a whole table
and grows with it. `{name}` stands for a given table or for another fixture.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .. import dims

GIVEN = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]
TODAY = "2024-01-30"
NOW = "2024-01-30 12:00:00"


def pick(expr: str, values: list) -> str:
    """CASE over 0..n-1."""
    quote = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"CASE {expr} " + " ".join(f"WHEN {i} THEN {quote(v)}" for i, v in enumerate(values)) + " END"


def text(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def div(expr: str, n: int) -> str:
    return f"CAST(floor(({expr}) / {n}) AS BIGINT)"


SITE_NAMES = ["Diner", "Cafe", "Salon", "Garage Ltd", "Plumbing & Heating", "Dental", "Bakery Limited"]
CATS = [c[0] for c in dims.CATEGORIES] + ["other"]
LABELS = [c[1] for c in dims.CATEGORIES] + ["Other"]
SITE_STATES_SQL = "('no_tag', 'social_only')"
HOSTS = [
    "youtube.com/@", "www.tiktok.com/@", "www.facebook.com/", "instagram.com/", "x.com/", "www.linkedin.com/in/",
    "pinterest.com/", "www.threads.net/", "t.me/", "wa.me/4420", "linktr.ee/", "other.example.com/",
]

FIXTURES: dict[str, str] = {}

_state = pick("(c_custkey * 7) % 15", dims.SITE_STATES)
FIXTURES["fx_business"] = f"""
SELECT id, 'node/' || {text('id')} AS osm_key, 'node' AS osm_type, name, name_normalized, category, category_label,
  city, country_code, address_line, street, house_number, site_state, enrichment_stage, enrichment_state,
  pipeline_stage, lat, lon,
  CASE WHEN site_state NOT IN {SITE_STATES_SQL} THEN 'https://www.site' || {text(div('id', 2))} || '.example.com/' END
    AS website_url,
  CASE WHEN site_state NOT IN {SITE_STATES_SQL} THEN 'example.com' END AS website_domain,
  CASE WHEN site_state NOT IN {SITE_STATES_SQL} THEN 'site' || {text(div('id', 2))} || '.Example.com'
       WHEN site_state = 'social_only' THEN 'facebook.com' ELSE address_line END AS dedupe_key,
  CASE WHEN id % 5 = 0 THEN '["redirected to parking host sedo.com"]' WHEN id % 5 = 1 THEN 'not json' ELSE '[]' END
    AS parking_evidence,
  first_seen_at, score_version, scored_at
FROM (
  SELECT c_custkey AS id,
    c_name || ' ' || {pick('c_custkey % 7', SITE_NAMES)} AS name,
    'shop ' || {text(div('c_custkey', 3) + ' % 50')} AS name_normalized,
    {pick('c_custkey % 10', CATS)} AS category, {pick('c_custkey % 10', LABELS)} AS category_label,
    {pick('c_custkey % 4', ['Frome', 'Bath, "Somerset"', None, 'Leeds'])} AS city,
    {pick('c_custkey % 3', ['gb', None, 'us'])} AS country_code,
    {text('1 + c_custkey % 90')} || ' High Street' AS address_line,
    'High Street' AS street, {text('1 + c_custkey % 90')} AS house_number,
    {_state} AS site_state,
    {pick('c_custkey % 6', dims.ENRICHMENT_STAGES)} AS enrichment_stage,
    {pick('c_custkey % 4', ['pending', 'running', 'done', 'failed'])} AS enrichment_state,
    {pick('(c_custkey * 3) % 5', dims.PIPELINE_STAGES)} AS pipeline_stage,
    51 + CAST(c_custkey % 400 AS DOUBLE) / 5000 AS lat, CAST(c_custkey % 37 AS DOUBLE) / 5000 - 2 AS lon,
    CAST(DATE '2024-01-01' + CAST(c_custkey % 30 AS INTEGER) AS TIMESTAMP) AS first_seen_at,
    CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 1 END AS score_version,
    CASE WHEN c_custkey % 11 <> 0 THEN CAST(DATE '2024-01-30' AS TIMESTAMP) END AS scored_at
  FROM {{customer}}) b"""

FIXTURES["fx_phone"] = " UNION ALL ".join(f"""
SELECT c_custkey * 2 + {n} AS id, c_custkey AS business_id, '020 ' || {text(f'1000000 + c_custkey * 2 + {n}')} AS raw,
  CASE WHEN (c_custkey + {n}) % 4 <> 0 THEN '+1555' || lpad({text(f'c_custkey * 2 + {n}')}, 7, '0') END AS e164,
  {'CAST(70 AS BIGINT)' if n else 'CAST(50 + c_custkey % 3 * 20 AS BIGINT)'} AS confidence, 'osm' AS source
FROM {{customer}} WHERE c_custkey % 3 <> 0""" for n in (0, 1))

FIXTURES["fx_email"] = " UNION ALL ".join(f"""
SELECT c_custkey * 3 + {n} AS id, c_custkey AS business_id,
  {pick(f'(c_custkey + {n}) % 3', ['info', 'jane.doe', 'noreply'])} || {text(str(n))} || '@shop' || {text('c_custkey')}
    || '.co.uk' AS address,
  {pick(f'(c_custkey + {n}) % 3', ['role', 'personal', 'noreply'])} AS kind,
  CAST({60 + 10 * n} AS BIGINT) AS confidence, 'site' AS source
FROM {{customer}} WHERE c_custkey % 4 <> 1 AND ({n} = 0 OR c_custkey % 2 = 0)""" for n in (0, 1, 2))

FIXTURES["fx_social"] = f"""
SELECT id, business_id, platform, handle, 'https://' || host || handle AS url, handle AS handle_normalized,
  CAST(floor(price) AS BIGINT) % 20000 AS followers,
  {pick('id % 6', dims.FOLLOWERS_STATES)} AS followers_state, CAST(NULL AS STRING) AS followers_reason,
  CASE WHEN id % 11 = 0 THEN id % 30000 END AS manual_override, id % 7 = 0 AS has_video
FROM (
  SELECT min(o_orderkey) AS id, o_custkey AS business_id, platform, handle, host,
    min_by(o_totalprice, o_orderkey) AS price
  FROM (
    SELECT o_orderkey, o_custkey, o_totalprice, 'h' || {text('o_orderkey % 3')} AS handle,
      {pick('o_orderkey % 12', dims.SOCIAL_PLATFORMS)} AS platform, {pick('o_orderkey % 12', HOSTS)} AS host
    FROM {{orders}} WHERE o_custkey % 6 <> 0) o
  GROUP BY o_custkey, platform, handle, host) s"""

FIXTURES["fx_task"] = f"""
SELECT event_id AS id, CASE WHEN event_id % 13 <> 0 THEN user_id END AS business_id,
  'Task ' || {text('event_id')} AS title, CASE WHEN event_id % 4 = 0 THEN 'note ' || {text('event_id % 9')} END AS note,
  CAST(ts AS DATE) + CAST(event_id % 9 AS INTEGER) AS due_date,
  {pick('event_id % 5', ['open', 'open', 'done', 'snoozed', 'cancelled'])} AS status,
  {pick('event_id % 5', dims.TASK_CHANNELS)} AS channel,
  CASE WHEN event_id % 5 = 2 THEN ts + INTERVAL '1' DAY * CAST(event_id % 3 AS INTEGER) END AS done_at,
  CAST(NULL AS TIMESTAMP) AS snooze_until, ts AS created_at, event_id % 10 AS position
FROM {{events}} WHERE event_type IN ('click', 'view')"""

_kind = "CASE WHEN event_type = 'click' THEN 'task_created' ELSE 'stage_change' END"
_meta = ("CASE event_type WHEN 'signup' THEN '{{\"fromStage\":\"new\",\"toStage\":\"contacted\"}}' "
         "WHEN 'view' THEN '{{\"fromStage\":\"contacted\",\"toStage\":\"replied\"}}' "
         "WHEN 'purchase' THEN '{{\"fromStage\":\"replied\",\"toStage\":\"won\"}}' "
         "WHEN 'error' THEN '{{\"fromStage\":\"new\",\"toStage\":\"lost\"}}' ELSE '{{}}' END")
FIXTURES["fx_activity"] = f"""
SELECT event_id AS id, {_kind} AS kind, user_id AS business_id, ts AS at, CAST(ts AS DATE) AS day, {_meta} AS meta
FROM {{events}}"""

FIXTURES["fx_stage_edit"] = f"""
SELECT event_id AS id, user_id AS business_id, ts AS at, {pick('event_id % 5', dims.PIPELINE_STAGES)} AS to_stage
FROM {{events}} WHERE event_type IN ('signup', 'purchase')"""

FIXTURES["fx_task_patch"] = f"""
SELECT event_id AS id,
  CASE WHEN event_id % 3 = 0 THEN 'Retitled ' || {text('event_id')} END AS title,
  CASE WHEN event_id % 8 = 0 THEN 'new note' END AS note,
  CASE WHEN event_id % 4 = 1 THEN CAST(ts AS DATE) + 3 END AS due_date,
  {pick('event_id % 6', [None, 'done', 'open', 'done', 'snoozed', 'cancelled'])} AS status,
  CASE WHEN event_id % 6 = 4 THEN ts + INTERVAL '2' DAY END AS snooze_until
FROM {{events}} WHERE event_type = 'click'"""

# ------------------------------------------------------------------ POIs
_sites = ["https://www.Shop{k}.co.uk/?utm_source=map#top", "www.shop{k}.com/home?b=2&a=1", "https://www.facebook.com/Shop{k}",
          "https://linktr.ee/shop{k}", "https://shop{k}.wixsite.com/home", None, "localhost", "http://a.b.shop{k}.com.br/;x"]


def _templated(template: str | None) -> str:
    if template is None:
        return "NULL"
    head, tail = template.split("{k}") if "{k}" in template else (template, None)
    return f"'{head}'" if tail is None else f"'{head}' || {text('k')} || '{tail}'"


_site_case = "CASE k % 8 " + " ".join(f"WHEN {i} THEN {_templated(t)}" for i, t in enumerate(_sites)) + " END"
_tag_key = pick("k % 12", ["amenity", "shop", "craft", "shop", "tourism", "office", "leisure", "amenity", "shop",
                           "healthcare", "amenity", "office"])
_tag_value = pick("k % 12", ["cafe;bar", "optician", "plumber", "photo", "hotel", "advertising_agency", "spa",
                             "bench", " car_repair ;x", "midwife", "studio", "it"])
FIXTURES["fx_poi_cols"] = f"""
SELECT k AS id, {pick('k % 3', ['node', 'way', 'relation'])} AS type,
  CASE WHEN k % 19 = 0 THEN '  ' WHEN k % 23 = 0 THEN NULL ELSE ' ' || c_name || {pick('k % 4', [' Ltd.', ' Cafe', '', ' & Sons Co'])} || ' ' END
    AS t_name,
  {_tag_key} AS tag_key, {_tag_value} AS tag_value, {_site_case} AS t_website,
  CASE WHEN k % 5 = 0 THEN '+44 20 7946 ' || lpad({text('k % 10000')}, 4, '0') || '; 020 7946 0999;'
       WHEN k % 5 = 1 THEN '555-0100' WHEN k % 5 = 2 THEN '+1 212 555 ' || lpad({text('k % 10000')}, 4, '0') END AS t_phone,
  CASE WHEN k % 4 = 0 THEN '020 7946 0999' END AS t_mobile,
  CASE WHEN k % 3 = 0 THEN 'Info@shop' || {text('k')} || '.co.uk;sales@shop.co.uk' WHEN k % 3 = 1 THEN 'a@b.co' END AS t_email,
  CASE WHEN k % 6 = 0 THEN 'https://instagram.com/Shop' || {text('k')} || '/' WHEN k % 6 = 1 THEN '@handle only' END
    AS t_instagram,
  CASE WHEN k % 7 = 0 THEN 'https://twitter.com/intent/tweet; https://x.com/Shop' || {text('k')} END AS t_x,
  CASE WHEN k % 17 = 0 THEN 'yes' WHEN k % 17 = 1 THEN 'No' END AS t_disused,
  CASE WHEN k % 29 = 0 THEN 'x' END AS t_was_shop, CASE WHEN k % 31 = 0 THEN 'Abandoned long ago' END AS t_lifecycle,
  CASE WHEN k % 3 <> 2 THEN {text('1 + k % 99')} END AS t_housenumber,
  CASE WHEN k % 5 <> 4 THEN ' High Street ' END AS t_street, CASE WHEN k % 2 = 0 THEN '1 Full Road' END AS t_full,
  CASE WHEN k % 4 = 0 THEN 'Frome' END AS t_city, CASE WHEN k % 4 = 1 THEN 'Bath' END AS t_town,
  CASE WHEN k % 4 <= 2 THEN 'Nunney' END AS t_village, CASE WHEN k % 3 = 0 THEN ' GB ' END AS t_country,
  'BA' || {text('k % 20')} AS t_postcode,
  51 + CAST(k % 400 AS DOUBLE) / 5000 AS lat, CAST(k % 37 AS DOUBLE) / 5000 - 2 AS lon
FROM (SELECT c_custkey AS k, c_name FROM {{customer}}) c"""

_TAGS = [("name", "t_name"), ("website", "t_website"), ("phone", "t_phone"), ("mobile", "t_mobile"),
         ("email", "t_email"), ("contact:instagram", "t_instagram"), ("contact:x", "t_x"), ("disused", "t_disused"),
         ("was:shop", "t_was_shop"), ("lifecycle", "t_lifecycle"), ("addr:housenumber", "t_housenumber"),
         ("addr:street", "t_street"), ("addr:full", "t_full"), ("addr:city", "t_city"), ("addr:town", "t_town"),
         ("addr:village", "t_village"), ("addr:country", "t_country"), ("addr:postcode", "t_postcode")]
_tags_json = " || ".join(f"coalesce(',\"{key}\":\"' || {col} || '\"', '')" for key, col in _TAGS)
FIXTURES["fx_poi_doc"] = f"""
SELECT id AS doc_id, 200 AS status,
  '{{{{"version":0.6,"osm3s":{{{{"timestamp_osm_base":"2024-01-' || lpad({text('1 + id % 28')}, 2, '0')
  || 'T00:00:00Z"}}}},"elements":[{{{{"type":"' || type || '","id":' || {text('id')}
  || CASE WHEN type = 'node' THEN ',"lat":' || {text('lat')} || ',"lon":' || {text('lon')}
          ELSE ',"center":{{{{"lat":' || {text('lat')} || ',"lon":' || {text('lon')} || '}}}}' END
  || ',"tags":{{{{"' || tag_key || '":"' || tag_value || '"' || {_tags_json} || '}}}}}}}},{{{{"type":"node","id":-'
  || {text('id + 1')} || '}}}}]}}}}' AS body
FROM {{fx_poi_cols}}"""

# a second run: other businesses under partly the same keys
FIXTURES["fx_poi_cols_2"] = FIXTURES["fx_poi_cols"].replace("SELECT c_custkey AS k, c_name FROM {customer}", "SELECT s_suppkey * 37 AS k, s_name AS c_name FROM {supplier}")
FIXTURES["fx_poi_doc_2"] = FIXTURES["fx_poi_doc"].replace("{fx_poi_cols}", "{fx_poi_cols_2}")

_bodies = [
    "", "   ", "<!DOCTYPE html><html><body>Error</body></html>",
    "<html><body>OSM3S Response Error : runtime error: Query timed out in \"query\" at line 3.</body></html>",
    "<html><head><title>504 Gateway Time-out</title></head></html>", "not json at all", '{"version":0.6}',
    '{"version":0.6,"remark":"runtime error: Query timed out in \\"query\\" at line 3","elements":[]}',
    '{"version":0.6,"remark":"note: something harmless","elements":[{"type":"node","id":1}]}', '{"elements":[]}',
    '{"elements":[{"type":"node","id":1},{"type":"way","id":2}]}', '{"elements":{"a":1}}',
]


def _literal(value: str) -> str:
    """A literal both dialects read alike: no backslash inside, quotes by chr()."""
    parts = []
    for i, piece in enumerate(value.split("\\")):
        if i:
            parts.append("chr(92)")
        if piece:
            parts.append("'" + piece.replace("{", "{{").replace("}", "}}") + "'")
    return " || ".join(parts) or "''"


FIXTURES["fx_body"] = f"""
SELECT event_id AS id, CAST({pick('event_id % 7', [200, 200, 504, 400, 429, 500, 200])} AS INTEGER) AS status,
  CASE event_id % 12 {' '.join(f'WHEN {i} THEN {_literal(b)}' for i, b in enumerate(_bodies))} END AS body
FROM {{events}}"""

FIXTURES["fx_response"] = f"""
SELECT event_id AS id, ts, 'm' || {text('user_id % 3')} AS source, user_id AS query_id, event_id % 20 AS tile,
  event_type <> 'error' AS ok, CAST(floor(value * 10) AS BIGINT) AS ms,
  CASE WHEN event_type <> 'error' THEN event_id % 4 END AS n_elements,
  CASE WHEN event_type = 'error' THEN {pick('event_id % 3', ['HTTP 504', 'timed out', 'HTTP 429'])} END AS error
FROM {{events}}"""

FIXTURES["fx_fetch"] = f"""
SELECT event_id AS id, ts AS fetched_at, 'd' || {text('user_id % 40')} || '.example.com' AS domain,
  'https://WWW.d' || {text('user_id % 40')} || '.example.com/p' || {text('event_id % 25')}
    || {pick('event_id % 3', ['?b=2&utm_source=x&a=1', '?a=1&b=2#top', '?a=1&ref=z&b=2'])} AS url,
  CAST({pick('event_id % 6', [200, 301, 404, 503, None, 200])} AS INTEGER) AS status,
  CASE WHEN event_id % 6 = 4 THEN {pick('event_id % 9', [
      'getaddrinfo ENOTFOUND x', 'connect ECONNREFUSED', 'CERT_HAS_EXPIRED', 'connect ETIMEDOUT', 'read ECONNRESET',
      'AbortError: stopped', 'boom', 'EAI_AGAIN y', 'request timed out'])} END AS error,
  CAST({pick('event_id % 3', [86400, 604800, 1800])} AS BIGINT) AS ttl_seconds, 'body ' || {text('event_id')} AS body
FROM {{events}}"""

FIXTURES["fx_run"] = f"""
SELECT user_id AS id, '  Frome   ' || {pick('user_id % 3', ['UK', 'uk', 'Somerset'])} AS location_text,
  min(ts) AS created_at,
  CASE WHEN user_id % 4 <> 0 THEN '2024-01-' || lpad({text('1 + user_id % 28')}, 2, '0') || 'T00:00:00Z' END AS osm_base,
  user_id % 10 = 0 AS aborted
FROM {{events}} GROUP BY user_id"""

FIXTURES["fx_tile"] = f"""
SELECT user_id AS query_id, event_id AS tile_index, CAST(event_id % 4 AS INTEGER) AS depth,
  CASE WHEN user_id % 5 = 1 THEN 'failed' ELSE {pick('event_id % 4', ['ok', 'split', 'failed', 'pending'])} END AS status,
  CASE WHEN user_id % 5 IN (1, 2) THEN 0 ELSE event_id % 50 END AS n_pois
FROM {{events}}"""

FIXTURES["fx_hit"] = """
SELECT o_orderkey AS hit_id, o_custkey % 40 AS query_id, o_orderkey % 16 AS tile_index,
  CASE o_custkey % 3 WHEN 0 THEN 'node/' WHEN 1 THEN 'way/' ELSE 'relation/' END || CAST(o_custkey AS STRING) AS osm_key,
  o_custkey AS business_id, o_orderdate AS seen_at
FROM {orders}"""

FIXTURES["fx_points"] = """
SELECT l_orderkey * 10 + l_linenumber AS point_id,
  50 + CAST((l_orderkey * 7919 + l_linenumber * 104729) % 1009 AS DOUBLE) / 1009 *
    CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE CAST(1 AS DOUBLE) / 4 END AS lat,
  CAST((l_orderkey * 104723 + l_linenumber * 7907) % 2003 AS DOUBLE) / 2003 *
    CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE CAST(1 AS DOUBLE) / 8 END - 2 AS lon
FROM {lineitem}"""

# ------------------------------------------------------------------ pages
_footer = (
    "'<footer>'"
    " || CASE WHEN page_id % 3 = 0 THEN '<a href=\"mailto:Info@shop' || {k} || '.co.uk?subject=x\">Mail</a>' ELSE '' END"
    " || CASE WHEN page_id % 5 = 0 THEN '<span data-cfemail=\"422a2b0231232e2d2c6c212d\">x</span>' ELSE '' END"
    " || CASE WHEN page_id % 4 = 0 THEN '<a href=\"tel:+44 20 7946 ' || lpad({m}, 4, '0') || '\">Call</a>' ELSE '' END"
    " || CASE WHEN page_id % 6 = 0 THEN '<a href=\"https://wa.me/4420794' || lpad({m}, 5, '0') || '\">Chat</a>' ELSE '' END"
    " || '<a href=\"https://www.facebook.com/Shop' || {k} || '/\">fb</a>'"
    " || CASE WHEN page_id % 2 = 0 THEN '<a href=\"https://www.facebook.com/sharer/sharer.php?u=x\">share</a>' ELSE '' END"
    " || CASE WHEN page_id % 7 = 0 THEN '<a href=\"https://linktr.ee/shop' || {k} || '\">links</a>' ELSE '' END"
    " || CASE WHEN page_id % 4 = 1 THEN '<a href=\"/contact\">Contact us</a><a href=\"/about/team.html\">Who</a>"
    "<a href=\"/company/a/b?utm_medium=q\">Firm</a>' ELSE '' END"
    " || CASE WHEN page_id % 8 = 3 THEN '<p>Write to sales' || {k} || '@firm' || {k} || '.de or call 030 123456' || {m}"
    " || ', see https://instagram.com/firm' || {k} || '.</p>' ELSE '' END"
    " || CASE WHEN page_id % 9 = 4 THEN '<p>jo (at) firm' || {k} || ' (dot) de</p>' ELSE '' END"
    " || CASE WHEN page_id % 10 = 0 THEN '<script type=\"application/ld+json\">{{\"@type\":\"LocalBusiness\",\"email\":"
    "\"mailto:ld' || {k} || '@firm.fr\",\"telephone\":\"+33 1 23 45 67 89\",\"sameAs\":[\"https://x.com/firm' || {k} || '\","
    "\"https://youtube.com/@firm' || {k} || '\"]}}</script>' ELSE '' END"
    " || CASE WHEN page_id % 15 = 6 THEN '<p>This domain is for sale. Buy this domain today.</p>' ELSE '' END"
    " || CASE WHEN page_id % 11 = 0 THEN '<link href=\"/wp-content/x.css\"><iframe src=\"https://www.youtube.com/embed/1\">"
    "</iframe>' ELSE '' END"
    " || CASE WHEN page_id % 3 = 1 THEN '<a href=\"' || regexp_extract(url, '^https?://[^/?#]+', 0) || '/own\">own</a>'"
    " ELSE '' END || '</footer></body></html>'"
).replace("{k}", text("page_id")).replace("{m}", text("page_id % 10000"))
FIXTURES["fx_page"] = f"""
SELECT page_id, url, 'p' || {text('page_id')} AS url_key, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
  html || {_footer} AS html,
  CAST({pick('page_id % 15', [200, 200, 200, 403, 404, 500, 200, None, None, 302, 200, 200, 418, None, 200])} AS INTEGER)
    AS status,
  CASE page_id % 15 WHEN 7 THEN 'dns_fail' WHEN 8 THEN 'refused' WHEN 13 THEN 'timeout' END AS error_kind,
  CASE page_id % 15 WHEN 9 THEN 'www.sedo.com' WHEN 14 THEN 'parking.godaddy.com' WHEN 10 THEN 'shop.example.com' END
    AS redirect_host,
  CASE WHEN page_id % 45 = 11 THEN 5 WHEN page_id % 15 IN (9, 10, 14) THEN 1 ELSE 0 END AS hops,
  page_id % 30 = 2 AS robots_blocked,
  {pick('page_id % 4', ['nginx/1.2', None, 'parking-server', 'cloudflare'])} AS server,
  CASE WHEN page_id % 13 = 5 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type,
  CAST(DATE '2024-01-01' + CAST(page_id % 30 AS INTEGER) AS TIMESTAMP) AS fetched_at
FROM {{pages}}"""

_robots = [
    "", "# just a comment", "User-agent: *~Disallow:", "User-agent: *~Disallow: /",
    "User-agent: *~Disallow: /~~User-agent: ShopfrontBot~Disallow: /en/4", "User-agent: *~Disallow: /en~Allow: /en/6",
    "User-agent: *~Disallow: /fr~Allow: /fr", "User-agent: *~Disallow: /*.html$ # no files~Disallow: /*page=",
    "User-agent: *~Crawl-delay: 2.5~Disallow: /de", "Sitemap: https://example.com/sitemap.xml~User-agent: *~Disallow: /es",
    "User-agent: *~Disallow: /en~~User-agent: someoneelse~Disallow: /~~User-agent: *~Disallow: /de",
    "User-agent: shop~User-agent: frontbot~Disallow: /en~Crawl-delay: x~Sitemap: https://a.test/s.xml~Disallow: /fr~nonsense",
]
FIXTURES["fx_robots"] = f"""
SELECT host AS domain, replace(CASE first_page % 12 {' '.join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_robots))} END,
    '~', chr(10)) AS body,
  CAST({pick('first_page % 7', [200, 200, 404, 503, 410, None, 200])} AS INTEGER) AS status
FROM (SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, min(page_id) AS first_page FROM {{pages}}
      GROUP BY regexp_extract(url, '^https?://([^/?#]+)', 1)) h"""

FIXTURES["fx_sitemap"] = f"""
SELECT page_id, '<urlset><url><loc>https://a.test/contact' || {text('page_id')} || '</loc></url><url><LOC> '
  || url || '&amp;b=2 </LOC></url><sitemap><loc>ftp://a.test/x</loc></sitemap></urlset>' AS xml
FROM {{pages}}"""

# Sites of several saved pages: the first page of an origin is the homepage, which links to the last and to one between. Those may
# have the usual contact address, so that they are found by guessing, or one that only the sitemap names.
_origin = "regexp_extract(url, '^https?://[^/?#]+', 0)"
FIXTURES["fx_origin"] = f"""
SELECT {_origin} AS origin, min(page_id) AS first_page, max(page_id) AS last_page, max(CASE WHEN page_id % 3 = 1 THEN page_id END) AS mid_page
FROM {{pages}} GROUP BY {_origin}"""
FIXTURES["fx_site_page"] = """
SELECT p.page_id, CASE WHEN page_id <> first_page AND page_id = last_page AND first_page % 3 = 0 THEN origin || '/contact'
    WHEN page_id <> first_page AND page_id = last_page AND first_page % 3 = 1 THEN origin || '/en/team' WHEN page_id <> first_page AND page_id = mid_page AND first_page % 4 = 2 THEN origin || '/about'
    ELSE url END AS url, host,
  CASE WHEN page_id = first_page THEN replace(html, '</footer>', '<a href="/contact">Contact us</a><a href="' || last_url || '">Our team</a><a href="'
    || coalesce(mid_url, '/none') || '">About</a><a href="https://elsewhere.example.com/contact">Contact</a></footer>') ELSE html END AS html,
  CAST(CASE WHEN page_id % 3 = 0 THEN 200 ELSE status END AS INTEGER) AS status, CASE WHEN page_id % 3 <> 0 THEN error_kind END AS error_kind,
  CASE WHEN page_id % 3 <> 0 THEN redirect_host END AS redirect_host, hops, robots_blocked, server, content_type, fetched_at
FROM {fx_page} p JOIN (SELECT origin, first_page, last_page, mid_page, last_url, mid_url FROM {fx_origin} o
  JOIN (SELECT page_id AS l, url AS last_url FROM {pages}) x ON x.l = o.last_page LEFT JOIN (SELECT page_id AS m, url AS mid_url FROM {pages}) y ON y.m = o.mid_page) s
  ON regexp_extract(p.url, '^https?://[^/?#]+', 0) = s.origin"""
FIXTURES["fx_site"] = f"""
SELECT first_page AS id, origin AS name, CASE WHEN first_page % 11 <> 5 THEN url END AS website_url,
  {pick('first_page % 3', ['gb', None, 'de'])} AS country_code
FROM {{fx_origin}} o JOIN {{pages}} p ON p.page_id = o.first_page"""
FIXTURES["fx_site_email"] = f"""
SELECT first_page AS id, first_page AS business_id, 'info@shop' || {text('first_page')} || '.co.uk' AS address, 'role' AS kind,
  CAST(60 AS BIGINT) AS confidence, 'osm' AS source FROM {{fx_origin}} WHERE first_page % 2 = 0"""
FIXTURES["fx_site_phone"] = """
SELECT first_page AS id, first_page AS business_id, '020 7946 0000' AS raw, CASE WHEN first_page % 2 = 0 THEN '+442079460000' END AS e164,
  CAST(70 AS BIGINT) AS confidence, 'osm' AS source FROM {fx_origin} WHERE first_page % 5 = 0"""
FIXTURES["fx_site_social"] = f"""
SELECT first_page AS id, first_page AS business_id, 'facebook' AS platform, 'Shop' || {text('first_page')} AS handle_normalized,
  'https://facebook.com/old' AS url, 'Shop' || {text('first_page')} AS handle, CAST(7 AS BIGINT) AS followers, 'known' AS followers_state,
  CAST(NULL AS STRING) AS followers_reason, CAST(NULL AS BIGINT) AS manual_override, false AS has_video
FROM {{fx_origin}} WHERE first_page % 3 = 1 OR first_page % 11 = 5"""
FIXTURES["fx_site_robots"] = f"""
SELECT regexp_extract(origin, '^https?://(.*)$', 1) AS domain,
  min({pick('first_page % 4', ['User-agent: *', 'User-agent: *~Disallow: /en/team', 'User-agent: *~Disallow: /about', 'User-agent: *~Disallow: /nothing'])}) || '~Sitemap: '
    || min(origin) || '/sitemap.xml' AS body, max(CASE WHEN first_page % 13 = 0 THEN 404 ELSE 200 END) AS status
FROM {{fx_origin}} GROUP BY regexp_extract(origin, '^https?://(.*)$', 1)"""
FIXTURES["fx_site_map"] = """
SELECT origin || '/sitemap.xml' AS url, '<urlset><url><loc>' || origin || '/shop/1</loc></url><url><loc>' || origin || '/en/team</loc></url><url><loc>'
  || origin || '/about</loc></url><url><loc>' || origin || '/contact/late</loc></url></urlset>' AS xml
FROM {fx_origin}"""

_profile = [
    "{\"subscriberCountText\":{\"simpleText\":\"1.2K subscribers\"},\"videoId\":\"x\"}", "{\"followerCount\":~,\"videoCount\": 3}",
    "<meta property=\"og:description\" content=\"~ followers, 3,4M likes\">", "{\"edge_followed_by\":{\"count\":~}}",
    "please log in to continue", "<p>hello</p>", "<meta name=\"description\" content=\"12,345 likes\">", "captcha",
]
FIXTURES["fx_profile"] = f"""
SELECT id AS social_id, CASE WHEN platform = 'facebook' THEN url || '/about' ELSE url END AS profile_url,
  min(replace(CASE id % 8 {' '.join(f"WHEN {i} THEN {_literal(t)}" for i, t in enumerate(_profile))} END,
    '~', {text('followers')})) AS html,
  min(CAST({pick('id % 9', [200, 200, 429, 403, None, 200, 200, 404, 200])} AS INTEGER)) AS status,
  min(CASE WHEN id % 10 = 3 THEN 1 ELSE 0 END) AS robots_blocked
FROM {{fx_social}} GROUP BY id, CASE WHEN platform = 'facebook' THEN url || '/about' ELSE url END"""

FIXTURES["fx_progress"] = f"""
SELECT event_id AS id, ts AS at, CASE event_type
  WHEN 'click' THEN '{{{{"type":"discovery","queryId":' || {text('user_id')} || ',"status":"running","poisFound":' || {text('event_id')} || '}}}}'
  WHEN 'view' THEN '{{{{"type":"queue","pending":' || {text('event_id % 9')} || '}}}}'
  WHEN 'signup' THEN '{{{{"type":"log","level":"' || {pick('event_id % 3', ['info', 'loud', 'error'])} || '","message":"m' || {text('event_id')} || '"}}}}'
  WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN '{{{{"type":"lead","businessId":' || {text('user_id')} || ',"stage":"probe","score":7}}}}'
    ELSE '{{{{"type":"lead","stage":"probe"}}}}' END
  ELSE CASE WHEN event_id % 3 = 0 THEN 'oops' WHEN event_id % 3 = 1 THEN '{{{{"type":"mystery"}}}}' ELSE '{{{{"type":"ping","at":5}}}}' END END AS value
FROM {{events}}"""

FIXTURES["fx_geocode"] = f"""
SELECT n_nationkey AS place_id, lower(n_name) || ' town' AS location_key, n_name AS display_name,
  lower(substr(n_name, 1, 2)) AS country_code, {pick('n_nationkey % 3', ['relation', 'way', 'node'])} AS osm_type,
  CAST(1000 + n_nationkey AS BIGINT) AS osm_id, CAST(n_nationkey AS DOUBLE) AS b0, CAST(n_nationkey + 1 AS DOUBLE) AS b1,
  CAST(n_nationkey AS DOUBLE) - 20 AS b2, CAST(n_nationkey AS DOUBLE) - 19 AS b3,
  CASE WHEN n_nationkey % 7 = 3 THEN 'error' ELSE 'ok' END AS fetch_state
FROM {{nation}}"""
FIXTURES["fx_place_request"] = """
SELECT c_custkey AS request_id, '  ' || n_name || '   Town ' AS location_text
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"""

# searches: a whole number and a word, the beginning of a number with the beginning of a word, words alone that nobody has, and a few signs
FIXTURES["fx_search"] = f"""
SELECT c_custkey AS query_id, CASE WHEN c_custkey % 500 = 7 THEN ' & ' WHEN c_custkey % 500 = 8 THEN '%' WHEN c_custkey % 4 = 0 THEN 'CUSTOMER, ' || substr(c_name, 10)
    WHEN c_custkey % 4 = 1 THEN substr(c_name, 10, 8) || ' ' || {pick('c_custkey % 6', ['din', 'caf', 'Salon', 'gar', 'plumb heat', 'x'])}
    WHEN c_custkey % 4 = 2 THEN 'high st ' || substr(c_name, 10, 8) ELSE 'nobody ' || {text('c_custkey')} END AS q
FROM {{customer}}"""

FIXTURES["fx_merge"] = """
SELECT c_custkey AS drop_id, c_custkey - 1 AS keep_id FROM {customer} WHERE c_custkey % 10 = 7"""
FIXTURES["fx_delete"] = "SELECT c_custkey AS id FROM {customer} WHERE c_custkey % 9 = 4"
FIXTURES["fx_override"] = """
SELECT id AS social_id, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN -5 ELSE id % 5000 END AS value
FROM {fx_social} WHERE id % 3 = 0"""
FIXTURES["fx_doc_text"] = f"""
SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' Mail SALES' || {text('doc_id')} || '@firm.co.uk., x@example.com a1@b.png '
    || '1234@x.com call (020) 7946-0' || {text('100 + doc_id % 900')} || ' or +49 30 1234567, 10:30 - 18:00' ELSE '' END AS text
FROM {{documents}}"""


def needed(sql: str) -> list[str]:
    """Names used in a fixture or oracle text, in the order they must be defined."""
    from .oracle_tables import DERIVED

    known = {**FIXTURES, **DERIVED}
    order: list[str] = []

    def visit(body: str) -> None:
        for name in re.findall(r"\b(?:fx|or)_[a-z0-9_]+\b", body):
            if name in known and name not in order:
                visit(known[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def duck(sql: str) -> str:
    """An oracle query with the tables it needs as common table expressions."""
    from .oracle_tables import DERIVED

    given = {name: name for name in GIVEN}
    parts = []
    for name in needed(sql):
        if name in FIXTURES:
            body = FIXTURES[name].format(**given, **{n: n for n in FIXTURES})
        else:
            body = DERIVED[name]
        parts.append(f"{name} AS MATERIALIZED ({body})")
    if sql.lstrip().startswith("WITH"):
        sql = f"SELECT * FROM ({sql})"
    return (f"WITH {', '.join(parts)} " if parts else "") + sql


#: Fixtures whose rows are parsed at length, while those of the tables behind them are a few bytes: such a table is dealt out by its rows.
DEALT = ["fx_poi_cols", "fx_poi_doc", "fx_poi_doc_2", "fx_fetch"]
ROWS_PER_TASK = 25_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a fixture built from the given tables, as a DataFrame."""
    if name in GIVEN:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(_spark_text(spark, sf_dir, name, name in DEALT))


def _spark_text(spark: SparkSession, sf_dir: str, name: str, dealt: bool) -> str:
    names = set(re.findall(r"(?<!\{)\{([a-z_0-9]+)\}(?!\})", FIXTURES[name]))
    given = _dealt_text if dealt else lambda _, path: f"parquet.`{path}`"
    values = {n: given(spark, f"{sf_dir}/{n}.parquet") if n in GIVEN else f"({_spark_text(spark, sf_dir, n, dealt)})" for n in names}
    return FIXTURES[name].format(**values)


def _dealt_text(spark: SparkSession, path: str) -> str:
    """A given table over all cores, and over more tasks as it grows: half a million of its rows may be one split of a file. The count reads footers only."""
    tasks = max(spark.sparkContext.defaultParallelism, -(-spark.read.parquet(path).count() // ROWS_PER_TASK))
    return f"(SELECT /*+ REPARTITION({tasks}) */ * FROM parquet.`{path}`)"
