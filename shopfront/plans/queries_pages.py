"""URLs, page snapshots, site verdicts and page selection."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import site as ST
from ..functions import urls as U
from ..operators import enrichment as E
from ..operators.workspace import Workspace
from ..sources import tables as T
from . import oracle_tables as O
from .fixtures import NOW
from .registry import query

join = lambda c, sep="|": F.array_join(c, sep)
ALL_URLS = "(SELECT 'page' AS src, page_id AS id, url AS raw FROM fx_page UNION ALL SELECT 'poi', id, t_website FROM fx_poi_cols UNION ALL SELECT 'social', id, url FROM fx_social UNION ALL SELECT 'fetch', id, url FROM fx_fetch)"


def all_urls(t):
    row = lambda df, src, id_, raw: df.select(F.lit(src).alias("src"), F.col(id_).alias("id"), F.col(raw).alias("raw"))
    return row(t.page, "page", "page_id", "url").unionByName(row(t.poi_cols, "poi", "id", "t_website")).unionByName(
        row(t.social, "social", "id", "url")).unionByName(row(t.fetch, "fetch", "id", "url"))


@query("A3_page_source", "SELECT page_id, url, status, content_type FROM fx_page WHERE regexp_matches(content_type, '(?i)text/html|application/xhtml')")
def _(t):
    saved = Workspace(t.spark, "saved-pages")
    saved.written(t.page, "pages")
    return T.read_pages(t.spark, f"{saved.path}/pages").select("page_id", "url", "status", "content_type")


@query("J1_normalize_url", f"SELECT src, id, n_host AS host, n_url AS url FROM ({O.identity(ALL_URLS, 'raw')})")
def _(t):
    return U.url_identity(all_urls(t), "raw").select("src", "id", F.col("n_host").alias("host"), F.col("n_url").alias("url"))


@query("J2_registrable_domain", f"SELECT src, id, n_domain AS domain, n_dedupe_key AS dedupe_key FROM ({O.identity(ALL_URLS, 'raw')})")
def _(t):
    return U.url_identity(all_urls(t), "raw").select("src", "id", F.col("n_domain").alias("domain"), F.col("n_dedupe_key").alias("dedupe_key"))


@query("J3_social_identity", f"SELECT src, id, n_platform AS platform, n_handle AS handle, n_share AS share, n_is_hub AS is_hub FROM ({O.identity(ALL_URLS, 'raw')})")
def _(t):
    n = lambda c: F.col("n_" + c).alias(c)
    return U.url_identity(all_urls(t), "raw").select("src", "id", n("platform"), n("handle"), n("share"), n("is_hub"))


_sorted = f"list_sort({O.KEPT})"
CACHE_KEY = f"u_scheme || '://' || regexp_replace(u_host, '^www\\.', '') || u_port || u_path || {O.query_text(_sorted)}"


@query("J4_cache_key", f"SELECT src, id, {CACHE_KEY} AS cache_key FROM ({O.url_parts(ALL_URLS, 'raw')})")
def _(t):
    return U.cache_key(all_urls(t), "raw").select("src", "id", "cache_key")


@query("J20_normalize_host", r"SELECT page_id, regexp_replace(regexp_replace(lower(trim(host || ':8080')), '\.$', ''), ':\d+$', '') AS host, lower(host) AS dotted FROM fx_page")
def _(t):
    return t.page.select("page_id", U.normalize_host(F.concat(F.lit(" "), F.upper("host"), F.lit(":8080 "))).alias("host"),
                         U.normalize_host(F.concat("host", F.lit("."))).alias("dotted"))


@query("J21_error_kind", """SELECT id, CASE WHEN error IS NULL THEN NULL WHEN regexp_matches(error, '(?i)ENOTFOUND|EAI_AGAIN') THEN 'dns_fail' WHEN error ILIKE '%ECONNREFUSED%' THEN 'refused'
  WHEN regexp_matches(error, '(?i)CERT|TLS|SSL') THEN 'tls' WHEN regexp_matches(error, '(?i)ETIMEDOUT|timed? ?out') THEN 'timeout' WHEN error ILIKE '%ECONNRESET%' THEN 'socket'
  WHEN error LIKE 'AbortError%' THEN 'timeout' ELSE 'unknown' END AS kind FROM fx_fetch""")
def _(t):
    return t.fetch.select("id", U.error_kind(F.col("error")).alias("kind"))


@query("C8_host_class", f"SELECT src, id, CASE WHEN n_platform IS NOT NULL THEN 'social' WHEN n_is_hub THEN 'hub' WHEN {O.under('n_host', dims.FREE_HOST_SUFFIXES)} THEN 'free'"
       f" WHEN {O.under('n_host', dims.PARKING_HOSTS)} THEN 'parking' WHEN n_host IS NOT NULL THEN 'own' END AS class FROM ({O.identity(ALL_URLS, 'raw')})")
def _(t):
    host = F.col("n_host")
    kind = (F.when(host.isNull(), None).when(U.social_platform(host).isNotNull(), "social").when(U.is_link_hub(host), "hub")
            .when(U.is_free_host(host), "free").when(U.under_any(host, dims.PARKING_HOSTS), "parking").otherwise("own"))
    return U.url_identity(all_urls(t), "raw").select("src", "id", kind.alias("class"))


@query("C7_page_body", "SELECT m.page_id, m.status, length(b.html) AS n_chars FROM fx_page m LEFT JOIN (SELECT url_key, html FROM fx_page WHERE status IS NOT NULL) b USING (url_key)")
def _(t):
    meta = t.page.select("page_id", "url_key", "status", "content_type")
    bodies = t.page.filter("status IS NOT NULL").select("url_key", "html")
    return T.page_body(meta, bodies).select("page_id", "status", F.length("html").cast("bigint").alias("n_chars"))


@query("A6_fresh_pages", f"""SELECT url_key, id FROM (SELECT *, {CACHE_KEY} AS url_key FROM ({O.url_parts('fx_fetch', 'url')}) QUALIFY row_number() OVER (PARTITION BY {CACHE_KEY} ORDER BY fetched_at DESC, id DESC) = 1)
  WHERE status BETWEEN 200 AND 399 AND epoch(fetched_at)::BIGINT * 0 + floor(epoch(fetched_at)) + ttl_seconds > epoch(TIMESTAMP '{NOW}')""")
def _(t):
    return T.fresh_pages(t.fetch, NOW).select("url_key", "id")


# ---------------------------------------------------------------- verdicts
def pages(t):
    return probe_view(t.page)


def probe_view(snapshots):
    """Snapshots with the redirect hosts and TLS flag a probe sees."""
    return snapshots.withColumns({
        "redirect_hosts": F.array_compact(F.array("redirect_host")), "final_url": F.col("url"), "has_ssl": F.col("url").startswith("https://"),
        "html": F.when(F.col("status").isNotNull(), F.col("html"))})


_parked = O.under("redirect_host", dims.PARKING_HOSTS)
_parses = "(NOT robots_blocked AND status BETWEEN 200 AND 299)"
_own = r"""len(list_filter(regexp_extract_all(html, '(?i)href=["''](https?://[^"'']+)["'']', 1), lambda u: lower(regexp_extract(u, '(?i)^https?://([^/?#]*)', 1)) = lower(host))) > 0"""
_redir = f"CASE WHEN {_parked} THEN 'redirected to parking host ' || redirect_host END"
_said = ", ".join(f"CASE WHEN regexp_matches(lower(html), '{p}') THEN '{l}' END" for p, l in dims.PARKING_PHRASES)
_verdict = f"""SELECT *, CASE WHEN robots_blocked THEN 'robots_disallowed'
    WHEN status IS NULL AND error_kind IS NOT NULL THEN CASE error_kind WHEN 'dns_fail' THEN 'dead' WHEN 'refused' THEN 'server_down' WHEN 'timeout' THEN 'timeout' ELSE 'dead' END
    WHEN parked AND status BETWEEN 300 AND 399 THEN 'parked' WHEN status IN (401, 403, 429) THEN 'blocked' WHEN status IN (404, 410) THEN 'dead' WHEN status >= 500 THEN 'server_error'
    WHEN coalesce(status, 0) NOT BETWEEN 200 AND 299 THEN 'dead' WHEN len(evidence) >= 2 THEN 'parked' WHEN url NOT LIKE 'https://%' THEN 'live_insecure'
    WHEN thin OR NOT own THEN 'live_weak' ELSE 'live' END AS site_state FROM (
  SELECT *, list_filter(CASE WHEN robots_blocked THEN [] WHEN parses THEN [{_redir}, {_said}, CASE WHEN server ILIKE '%parking%' THEN 'server header reports "' || server || '"' END,
      CASE WHEN thin AND NOT own THEN 'page is only ' || greatest(1, floor(length(html) / 1024.0 + 0.5)::BIGINT) || ' KB and links to no page of its own' END]
      ELSE [{_redir}, CASE WHEN status IS NULL AND error_kind = 'dns_fail' THEN 'domain does not resolve' END] END, lambda e: e IS NOT NULL) AS evidence FROM (
    SELECT *, coalesce({_parked}, false) AS parked, {_parses} IS TRUE AS parses, {_own} AS own, {_parses} IS TRUE AND length(html) < 12000 AS thin FROM fx_page))"""


@query("J14_site_verdict", f"SELECT page_id, site_state, array_to_string(evidence, '|') AS evidence, thin FROM ({_verdict})")
def _(t):
    return ST.site_verdict(pages(t)).select("page_id", "site_state", join("evidence").alias("evidence"), "thin")


def _first(col: str, pairs) -> str:
    return "".join(f" WHEN regexp_matches({col}, '(?i){p}') THEN '{n}'" for n, p in pairs)


_platform = f"CASE{_first('html', dims.SITE_PLATFORMS)}{_first('server', dims.SERVER_PLATFORMS)} END"
_title = r"nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), '')"
_video = f"regexp_matches(html, '(?i){'|'.join(dims.VIDEO_MARKERS)}')"


@query("J15_site_facts", f"SELECT page_id, {_platform} AS platform, {_title} AS title, {_video} AS has_video FROM fx_page")
def _(t):
    return E.site_facts(t.page).select("page_id", "platform", "title", "has_video")


def leads_with_pages(t):
    """Every lead with the key of its homepage snapshot; most have none saved."""
    return t.business.withColumn("url_key", F.concat(F.lit("p"), F.col("id").cast("string")))


_leadpage = f"""SELECT b.id, b.website_url, v.hops, v.url AS page_url, v.page_id, CASE WHEN b.website_url IS NULL THEN CASE WHEN EXISTS (SELECT 1 FROM fx_social s WHERE s.business_id = b.id) THEN 'social_only' ELSE 'no_tag' END
    WHEN hops >= 5 THEN 'too_many_redirects' ELSE coalesce(v.site_state, 'has_tag_unprobed') END AS site_state,
  CASE WHEN b.website_url IS NULL THEN '' WHEN hops >= 5 THEN 'more than 5 redirects' ELSE coalesce(array_to_string(evidence, '|'), '') END AS evidence,
  CASE WHEN hops < 5 AND status IS NOT NULL THEN {_platform} END AS platform, CASE WHEN hops < 5 AND status IS NOT NULL THEN {_title} END AS title, v.status AS http_status
  FROM fx_business b LEFT JOIN ({_verdict}) v ON v.page_id = b.id"""


@query("K1_site_probe_job", f"SELECT id, site_state, evidence, platform, title, http_status, site_state IN ('server_error', 'timeout') AS retryable FROM ({_leadpage})")
def _(t):
    df = E.site_probe_job(leads_with_pages(t), pages(t), t.social)
    return df.select("id", "site_state", join("evidence").alias("evidence"), "platform", "title", "http_status", "retryable")


_stage = """CASE WHEN website_url IS NULL THEN 'contacts' WHEN site_state IN ('server_error', 'timeout') THEN 'probe' WHEN site_state = 'too_many_redirects' THEN 'probe'
  WHEN site_state IN ('live', 'live_weak', 'live_insecure') THEN CASE WHEN id % 2 = 0 THEN 'contacts' ELSE 'scrape' END ELSE 'socials' END"""


def probed(t):
    leads = E.site_probe_job(leads_with_pages(t), pages(t), t.social).join(t.page.select("url_key", "hops"), "url_key", "left")
    return leads.withColumn("scraped", F.col("id") % 2 == 0)


@query("K6_stage_derive", f"""SELECT l.id, CASE WHEN c.n > 0 THEN CASE WHEN c.open = 0 THEN 'socials' ELSE 'contacts' END ELSE {_stage.replace('id %', 'l.id %')} END AS enrichment_stage FROM ({_leadpage}) l LEFT JOIN
  (SELECT business_id, count(*) FILTER (WHERE id % 3 <> 0 OR business_id % 4 = 0) AS n, count(*) FILTER (WHERE NOT (id % 3 <> 0 OR business_id % 4 = 0)) AS open FROM fx_social GROUP BY business_id) c ON c.business_id = l.id""")
def _(t):
    socials = t.social.withColumn("checked", (F.col("id") % 3 != 0) | (F.col("business_id") % 4 == 0))
    return E.stage_derive(probed(t), socials).select("id", "enrichment_stage")


@query("K7_email_state", "SELECT id, CASE WHEN id % 2 <> 0 THEN 'unknown' WHEN EXISTS (SELECT 1 FROM fx_email e WHERE e.business_id = b.id) THEN 'found' ELSE 'none_found' END AS email_state FROM fx_business b")
def _(t):
    return E.email_state(t.business.withColumn("scraped", F.col("id") % 2 == 0), t.email).select("id", "email_state")


# ---------------------------------------------------------- page selection
def _links_sql() -> str:
    """All contact links of all pages, parsed by other expressions than the job's."""
    words, anchor = "(?i)" + dims.CONTACT_WORDS, r'(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"[^>]*>(.*?)</a\s*>'
    base = O.url_parts("fx_page", "url")
    absolute = """CASE WHEN raw = '' THEN NULL WHEN regexp_matches(raw, '(?i)^https?://') THEN raw WHEN starts_with(raw, '//') THEN b_scheme || ':' || raw
      WHEN starts_with(raw, '/') THEN origin || raw WHEN starts_with(raw, '?') THEN origin || b_path || raw WHEN starts_with(raw, '#') THEN origin || b_path || b_query
      WHEN regexp_matches(raw, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL ELSE origin || regexp_replace(b_path, '[^/]*$', '') || raw END"""
    rows = f"""(SELECT *, {absolute} AS abs FROM (SELECT page_id, u_scheme AS b_scheme, u_host AS b_host, u_port AS b_port, u_path AS b_path, u_query AS b_query,
      u_scheme || '://' || u_host || u_port AS origin, {O.entities("unnest(regexp_extract_all(html, '" + anchor + "', 1))")} AS raw,
      trim(regexp_replace({O.entities("regexp_replace(unnest(regexp_extract_all(html, '" + anchor + "', 2)), '<[^>]*>', '', 'g')")}, '\\s+', ' ', 'g')) AS text FROM ({base})))"""
    kept = "list_filter(params, lambda p: NOT regexp_matches(p, '^utm_|^(fbclid|gclid)(=|$)'))"
    query = f"CASE WHEN len({kept}) = len(params) THEN u_query WHEN len({kept}) = 0 THEN '' ELSE '?' || array_to_string({kept}, '&') END"
    return f"""SELECT page_id, href, max(score)::BIGINT AS score FROM (SELECT page_id, u_scheme || '://' || u_host || u_port || u_path || {query} AS href,
      CASE WHEN by_path THEN 3 ELSE 0 END + CASE WHEN by_text THEN 2 ELSE 0 END + greatest(0, 2 - len(list_filter(string_split(u_path, '/'), lambda s: s <> ''))) + CASE WHEN regexp_matches(u_path, '(?i)^/?contact') THEN 2 ELSE 0 END AS score
      FROM (SELECT *, regexp_matches(u_path, '{words}') AS by_path, coalesce(regexp_matches(text, '{words}'), false) AS by_text, list_filter(string_split(regexp_replace(u_query, '^\\?', ''), '&'), lambda p: p <> '') AS params
        FROM ({O.url_parts(rows, 'abs')}))
      WHERE u_scheme = b_scheme AND u_host = b_host AND u_port = b_port AND NOT regexp_matches(u_path, '(?i){dims.NOT_A_PAGE}') AND (by_path OR by_text)) GROUP BY page_id, href"""


@query("E8_contact_link_rank", _links_sql())
def _(t):
    return E.contact_link_rank(t.page, 1_000_000).select("page_id", "href", F.col("score").cast("bigint").alias("score"))


def _site(t):
    return t.page.select(F.col("page_id").alias("business_id"), "url")


@query("G3_frontier_union", """WITH s AS (SELECT page_id AS b, url, regexp_extract(url, '^https?://[^/?#]+', 0) AS o FROM fx_page),
  links AS (SELECT * FROM (SELECT b, 1 AS src, 0 AS pos, o || '/contact' AS url FROM s UNION ALL SELECT b, 1, 1, o || '/team' FROM s WHERE b % 2 = 0
    UNION ALL SELECT b, 2, i, o || g FROM s, (VALUES (0, '/contact'), (1, '/contact-us'), (2, '/about'), (3, '/contact.html')) x(i, g)) QUALIFY row_number() OVER (PARTITION BY b ORDER BY src, pos) <= 4),
  maps AS (SELECT b, 3 AS src, i AS pos, o || p AS url FROM s, (VALUES (2, '/about-map'), (3, '/en/team')) x(i, p)),
  every AS (SELECT b, 0 AS src, 0 AS pos, url FROM s UNION ALL SELECT * FROM links UNION ALL SELECT * FROM maps),
  once AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY b, url ORDER BY src, pos) = 1)
  SELECT b AS business_id, url, row_number() OVER (PARTITION BY b ORDER BY src, pos) - 1 AS ordinal FROM once""")
def _(t):
    return _frontier(t)


def _frontier(t):
    site = _site(t)
    origin = F.regexp_extract("url", "^https?://[^/?#]+", 0)
    paths = F.when(F.col("business_id") % 2 == 0, F.array(F.lit("/contact"), F.lit("/team"))).otherwise(F.array(F.lit("/contact")))
    ranked = site.select("business_id", F.posexplode(paths).alias("pos", "p"), origin.alias("o")).select("business_id", "pos", F.concat("o", "p").alias("url"))
    maps = site.select("business_id", F.posexplode(F.array(*map(F.lit, ("/blog/1", "/blog/2", "/about-map", "/en/team", "/contact-map")))).alias("pos", "p"), origin.alias("o")).select(
        "business_id", "pos", F.concat("o", "p").alias("url"))
    return E.frontier_union(site, ranked, E.guessed_urls(site), maps)


_cand = "SELECT event_id, user_id AS business_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ordinal, (event_id % 3 = 0)::INT AS e, (event_id % 2)::INT AS p, (event_id % 4 = 1)::INT AS s FROM events"


@query("E9_page_budget", f"""SELECT business_id, ordinal FROM (SELECT *, coalesce(sum(e) OVER w, 0) AS se, coalesce(sum(p) OVER w, 0) AS sp, coalesce(sum(s) OVER w, 0) AS ss FROM ({_cand})
  WINDOW w AS (PARTITION BY business_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE ordinal < 5 AND NOT (se > 0 AND sp > 0 AND ss >= 2)""")
def _(t):
    from ..operators.ordered import numbered

    ev = t.events.withColumns({"n_emails": (F.col("event_id") % 3 == 0).cast("int"), "n_phones": (F.col("event_id") % 2).cast("int"),
                               "n_socials": (F.col("event_id") % 4 == 1).cast("int")})
    rows = numbered(ev, ["user_id"], [F.col("ts"), F.col("event_id")], F.date_trunc("day", "ts"), "nth")
    cand = rows.select(F.col("user_id").alias("business_id"), (F.col("nth") - 1).alias("ordinal"), "n_emails", "n_phones", "n_socials")
    return E.page_budget(cand).select("business_id", "ordinal")
