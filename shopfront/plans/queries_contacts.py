"""Emails, phones, social profiles and follower counts from texts and pages; the whole chain."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import dims
from ..functions import contacts as C
from ..functions import html as H
from ..operators import enrichment as E
from ..operators import leads as L
from ..operators.ordered import first_per_key, insert_new
from ..operators.site_enrichment import enrich_sites
from ..operators.workspace import Workspace
from ..session import shared_dir
from . import oracle_tables as O
from .registry import query

join = lambda c, sep="|": F.array_join(c, sep)


@query("J7_find_emails", f"SELECT doc_id, array_to_string({O.find_emails('text')}, '|') AS emails FROM fx_doc_text")
def _(t):
    return t.doc_text.select("doc_id", join(C.find_emails(F.col("text"))).alias("emails"))


_inner = r"'\s*[(\[{]?\s*(?:dot|\.)\s*[)\]}]?\s*'"
_spelled = r"""'(?i)([a-z0-9._%+-]+)\s*[(\[{\s]?\s*(?:at|@|＠)\s*[)\]}\s]?\s*([a-z0-9-]+(?:\s*[(\[{]?\s*(?:dot|\.)\s*[)\]}]?\s*[a-z0-9-]+)+)'"""


def deobfuscated(e: str) -> str:
    plain = f"regexp_replace(regexp_replace({e}, '(?i)&#0*64;|&commat;', '@', 'g'), '(?i)&#0*46;|&period;', '.', 'g')"
    marked = rf"regexp_replace({plain}, {_spelled}, ' \1@' || chr(1) || '\2' || chr(1) || ' ', 'g')"
    pieces = f"list_transform(string_split({marked}, chr(1)), lambda p, i: CASE WHEN i % 2 = 0 THEN regexp_replace(p, '(?i)' || {_inner}, '.', 'g') ELSE p END)"
    return rf"regexp_replace(regexp_replace(array_to_string({pieces}, ''), '\s+@\s+', '@', 'g'), '\s+\.\s+', '.', 'g')"


@query("J8_deobfuscate", f"SELECT page_id, {deobfuscated('body_text')} AS text FROM or_page_text")
def _(t):
    return t.page.select("page_id", C.deobfuscate(H.body_text(F.col("html"))).alias("text"))




@query("J9_decode_protected", f"""SELECT page_id, CASE WHEN page_id % 200 = 66 THEN NULL ELSE 'hi@' || chr(xor((page_id % 200)::INT, 66)) || 'alon.co' END AS address FROM pages""")
def _(t):
    hex_text = F.concat(F.lit("422a2b02"), F.lpad(F.hex(F.col("page_id") % 200), 2, "0"), F.lit("232e2d2c6c212d"))
    return t.pages.select("page_id", C.decode_protected(hex_text).alias("address"))


@query("J10_email_kind", f"SELECT id, {O.KIND} AS kind, CASE WHEN id % 3 = 0 THEN {O.KIND_SWAPPED} END AS other FROM fx_email")
def _(t):
    other = C.email_kind(F.replace("address", F.lit("info"), F.lit("book-it")))
    return t.email.select("id", C.email_kind(F.col("address")).alias("kind"), F.when(F.col("id") % 3 == 0, other).alias("other"))


_found_phones = rf"list_filter(list_transform(regexp_extract_all(text, '{dims.PHONE_PATTERN}'), lambda v: {O.TIDY('v')}), lambda v: length({O.DIGITS('v')}) BETWEEN 7 AND 17 AND NOT {O.NOISE('v')})"


@query("J11_phone_candidates", f"SELECT doc_id, array_to_string(list_filter({_found_phones}, lambda v, i: list_position({_found_phones}, v) = i), '|') AS phones FROM fx_doc_text")
def _(t):
    return t.doc_text.select("doc_id", join(C.phone_candidates(F.col("text"))).alias("phones"))


_raws = """(SELECT id AS rid, country_code, raw FROM (SELECT b.id * 4 AS id, country_code, '020 7946 ' || lpad((b.id % 10000)::VARCHAR, 4, '0') AS raw FROM fx_business b UNION ALL
  SELECT b.id * 4 + 1, country_code, '+44 (0) 7700 900' || lpad((b.id % 1000)::VARCHAR, 3, '0') FROM fx_business b UNION ALL SELECT b.id * 4 + 2, NULL, '0049 30 ' || (100000 + b.id) FROM fx_business b
  UNION ALL SELECT b.id * 4 + 3, country_code, CASE b.id % 4 WHEN 0 THEN '12:30 - 18:00' WHEN 1 THEN '212-555-' || lpad((b.id % 10000)::VARCHAR, 4, '0') WHEN 2 THEN '2024' ELSE '999 1234567' END FROM fx_business b))"""


@query("J12_normalize_phone", f"SELECT rid AS id, e164, is_mobile, reject_reason FROM ({O.phones(_raws, 'raw', 'country_code')})")
def _(t):
    k = F.col("id")
    pad = lambda n: F.lpad((k % 10 ** n).cast("string"), n, "0")
    none = F.lit(None).cast("string")
    last = F.when(k % 4 == 0, "12:30 - 18:00").when(k % 4 == 1, F.concat(F.lit("212-555-"), pad(4))).when(k % 4 == 2, "2024").otherwise("999 1234567")
    raws = F.array(*(F.struct((k * 4 + i).alias("id"), country.alias("country_code"), raw.alias("raw")) for i, (country, raw) in enumerate([
        (F.col("country_code"), F.concat(F.lit("020 7946 "), pad(4))), (F.col("country_code"), F.concat(F.lit("+44 (0) 7700 900"), pad(3))),
        (none, F.concat(F.lit("0049 30 "), (k + 100000).cast("string"))), (F.col("country_code"), last)])))
    df = t.business.select(F.explode(raws).alias("r")).select("r.*")
    return C.add_phone(df, "raw", "country_code").select("id", "p.e164", "p.is_mobile", "p.reject_reason")


_num = r"regexp_replace(regexp_extract(lower(trim(s)), '(\d[\d\s.,]*)\s*(k|m|b|mil|mn|thousand|million|billion)?', 1), '\s', '', 'g')"
_unit = r"left(regexp_extract(lower(trim(s)), '(\d[\d\s.,]*)\s*(k|m|b|mil|mn|thousand|million|billion)?', 2), 1)"
_norm = rf"CASE WHEN regexp_matches({_num}, '^.*[.,]\d{{1,2}}$') THEN regexp_replace({_num}, '^(.*)[.,](\d{{1,2}})$', '\1.\2') ELSE regexp_replace({_num}, '[.,]', '', 'g') END"
_forms = ["id || ''", "(id // 1000 + 1) || ',' || lpad((id % 1000)::VARCHAR, 3, '0')", "(id % 90) || '.' || (id % 10) || 'K subscribers'", "(id % 9) || ',' || (id % 10) || 'M'", "'1,234.' || (id % 10)", "'none'",
          "(id % 7) || ' thousand'", "(id % 50) || '.' || lpad((id % 1000)::VARCHAR, 3, '0') || ' members'"]


@query("J13_human_number", f"SELECT id, CASE WHEN regexp_matches({_norm}, '^\\d+(\\.\\d+)?$') THEN floor(({_norm})::DOUBLE * CASE WHEN {_unit} IN ('k', 't') THEN 1e3 WHEN {_unit} = 'm' THEN 1e6 WHEN {_unit} = 'b' THEN 1e9 ELSE 1 END + 0.5)::BIGINT END AS n"
       f" FROM (SELECT id, CASE id % 8 {' '.join(f'WHEN {i} THEN {f}' for i, f in enumerate(_forms))} END AS s FROM fx_social)")
def _(t):
    k, s = F.col("id"), lambda e: e.cast("string")
    lit = F.lit
    forms = [s(k), F.concat(s(F.floor(k / 1000) + 1), lit(","), F.lpad(s(k % 1000), 3, "0")), F.concat(s(k % 90), lit("."), s(k % 10), lit("K subscribers")),
             F.concat(s(k % 9), lit(","), s(k % 10), lit("M")), F.concat(lit("1,234."), s(k % 10)), lit("none"), F.concat(s(k % 7), lit(" thousand")),
             F.concat(s(k % 50), lit("."), F.lpad(s(k % 1000), 3, "0"), lit(" members"))]
    text = F.get(F.array(*forms), (k % 8).cast("int"))
    return t.social.select("id", C.human_number(text).alias("n"))


# --------------------------------------------------------------- page jobs
_ld_strings = lambda key: f"""SELECT page_id, json_extract_string(j, '$.{key}') AS v FROM or_ld WHERE json_extract_string(j, '$.{key}') IS NOT NULL"""
_emails = f"""SELECT page_id, address, arg_min(source, (rk, pos)) AS source, arg_min(conf, (rk, pos)) AS confidence FROM (
  SELECT page_id, unnest(a) AS address, generate_subscripts(a, 1) AS pos, rk, source, conf FROM (
    SELECT page_id, flatten(list_transform(list_filter(hrefs, lambda h: lower(h) LIKE 'mailto:%'), lambda h: {O.find_emails('h')})) AS a, 0 AS rk, 'mailto' AS source, 0.95 AS conf FROM or_page_text
    UNION ALL SELECT page_id, {O.find_emails("regexp_replace(v, '(?i)^mailto:', '')")}, 1, 'jsonld', 0.9 FROM ({_ld_strings('email')})
    UNION ALL SELECT page_id, ['hi@salon.co'], 2, 'cf-decode', 0.85 FROM fx_page WHERE html LIKE '%data-cfemail="422a2b0231232e2d2c6c212d"%'
    UNION ALL SELECT page_id, {O.find_emails('body_text')}, 3, 'text', 0.8 FROM or_page_text
    UNION ALL SELECT page_id, {O.find_emails('d')}, 4, 'text', 0.6 FROM (SELECT page_id, {deobfuscated('body_text')} AS d FROM or_page_text))) GROUP BY page_id, address"""


@query("K2_email_extract_job", f"SELECT page_id, address, {O.KIND} AS kind, source, confidence::DOUBLE AS confidence FROM ({_emails})")
def _(t):
    return E.email_extract_job(t.page)


_phone_rows = rf"""(SELECT *, page_id || '/' || rk || '/' || pos AS rid, NULL::VARCHAR AS country_code FROM (SELECT page_id, {O.TIDY('unnest(a)')} AS raw, generate_subscripts(a, 1) AS pos, rk, source, conf FROM (
    SELECT page_id, list_filter(hrefs, lambda h: lower(h) LIKE 'tel:%') AS a, 0 AS rk, 'tel' AS source, 0.95 AS conf FROM or_page_text
    UNION ALL SELECT page_id, list_transform(list_filter(hrefs, lambda h: regexp_matches(h, '(?i)(wa\.me|api\.whatsapp\.com/send\?phone=)/?\+?\d{{6,}}')),
      lambda h: regexp_extract(h, '(?i)(?:wa\.me|api\.whatsapp\.com/send\?phone=)/?(\+?\d{{6,}})', 1)), 1, 'whatsapp', 0.9 FROM or_page_text
    UNION ALL SELECT page_id, [v], 2, 'jsonld', 0.85 FROM ({_ld_strings('telephone')})
    UNION ALL SELECT page_id, regexp_extract_all(body_text, '{dims.PHONE_PATTERN}'), 3, 'text', 0.6 FROM or_page_text)) WHERE length({O.DIGITS('raw')}) BETWEEN 7 AND 17)"""
_page_phones = f"""SELECT * FROM ({O.phones(_phone_rows, 'raw', 'country_code')}) QUALIFY row_number() OVER (PARTITION BY page_id, coalesce(e164, raw) ORDER BY rk, pos) = 1"""


@query("K3_phone_extract_job", f"SELECT page_id, raw, e164, is_mobile, source = 'whatsapp' AS is_whatsapp, source, conf::DOUBLE AS confidence, reject_reason FROM ({_page_phones})")
def _(t):
    return E.phone_extract_job(t.page)


_mention = dims.SOCIAL_MENTION
_social_src = f"""(SELECT page_id, unnest(a) AS raw, generate_subscripts(a, 1) AS pos, rk FROM (SELECT page_id, hrefs AS a, 0 AS rk FROM or_page_text
  UNION ALL SELECT page_id, from_json(j->'$.sameAs', '["VARCHAR"]'), 1 FROM or_ld WHERE json_type(j->'$.sameAs') = 'ARRAY'
  UNION ALL SELECT page_id, list_transform(regexp_extract_all(body_text, '{_mention}'), lambda m: 'https://' || m), 2 FROM or_page_text))"""
_socials = f"""SELECT page_id, platform, n_url AS url, n_handle AS handle, account FROM (SELECT *, CASE WHEN n_is_hub THEN 'linkinbio' ELSE n_platform END AS platform, coalesce(n_handle, lower(n_url)) AS account
  FROM ({O.identity(_social_src, 'raw')}) WHERE n_url IS NOT NULL AND (n_is_social OR n_is_hub) AND NOT n_share) QUALIFY row_number() OVER (PARTITION BY page_id, platform, account ORDER BY rk, pos) = 1"""


@query("K4_social_extract_job", f"SELECT page_id, platform, url, handle FROM ({_socials})")
def _(t):
    return E.social_extract_job(t.page)


@query("J18_jsonld_values", """SELECT page_id, 'email' AS key, json_extract_string(j, '$.email') AS value FROM or_ld WHERE json_extract_string(j, '$.email') IS NOT NULL
  UNION ALL SELECT page_id, 'telephone', json_extract_string(j, '$.telephone') FROM or_ld WHERE json_extract_string(j, '$.telephone') IS NOT NULL
  UNION ALL SELECT page_id, 'sameAs', unnest(from_json(j->'$.sameAs', '["VARCHAR"]')) FROM or_ld WHERE json_type(j->'$.sameAs') = 'ARRAY'""")
def _(t):
    return E.jsonld_values(t.page)


# ------------------------------------------------------------ contact sets
@query("C10_insert_or_ignore", """SELECT business_id, address, confidence FROM fx_email WHERE id % 2 = 0 UNION ALL SELECT business_id, address, confidence FROM (
  SELECT business_id, address, confidence FROM fx_email WHERE id % 2 = 1 UNION ALL SELECT business_id, address, -1 FROM fx_email WHERE id % 2 = 0)
  WHERE (business_id, address) NOT IN (SELECT (business_id, address) FROM fx_email WHERE id % 2 = 0)""")
def _(t):
    cols = t.email.select("id", "business_id", "address", "confidence")
    known = cols.filter("id % 2 = 0")
    again = cols.filter("id % 2 = 1").unionByName(known.withColumn("confidence", F.lit(-1).cast("bigint")))
    return insert_new(known, again, ["business_id", "address"], [F.col("id")]).select("business_id", "address", "confidence")


@query("G2_contact_union", """SELECT business_id, value, arg_min(source, rk) AS source FROM (SELECT business_id, address AS value, 'osm' AS source, 0 AS rk FROM fx_email WHERE id % 3 = 0
  UNION ALL SELECT business_id, address, 'site', 1 FROM fx_email) GROUP BY business_id, value""")
def _(t):
    part = lambda df, source, rank: df.select("business_id", F.col("address").alias("value"), F.lit(source).alias("source"), F.lit(rank).alias("rank"))
    both = part(t.email.filter("id % 3 = 0"), "osm", 0).unionByName(part(t.email, "site", 1))
    return first_per_key(both, ["business_id", "value"], [F.col("rank")]).drop("rank")


@query("G1_reason_union", f"SELECT id, CASE WHEN has_phone THEN 1 ELSE 0 END + CASE WHEN has_email THEN 1 ELSE 0 END + CASE WHEN has_social THEN 1 ELSE 0 END + CASE WHEN tier = 'unknown' THEN 1 ELSE 0 END"
       f" + CASE WHEN {O.PCT} < 100 THEN 1 ELSE 0 END + 1 AS n, string_split(reasons, '|')[1] AS first FROM or_lead")
def _(t):
    from ..functions import score as S

    return t.denorm().select("id", F.size(S.score_reasons()).cast("bigint").alias("n"), F.get(S.score_reasons(), F.lit(0)).alias("first"))


# --------------------------------------------------------------- followers
_about = "CASE WHEN platform = 'facebook' THEN url || '/about' ELSE url END"


_count = {
    "youtube": "CASE WHEN html LIKE '%subscriberCountText%' THEN 1200 END", "tiktok": r"try_cast(regexp_extract(html, '\"followerCount\":(\d+)', 1) AS BIGINT)",
    "facebook": r"coalesce(try_cast(nullif(regexp_extract(html, '\"followerCount\":(\d+)', 1), '') AS BIGINT), try_cast(nullif(regexp_extract(html, 'content=\"(\d+) followers', 1), '') AS BIGINT), CASE WHEN html LIKE '%12,345 likes%' THEN 12345 END)",
    "instagram": r"coalesce(try_cast(nullif(regexp_extract(html, '\"count\":(\d+)', 1), '') AS BIGINT), try_cast(nullif(regexp_extract(html, 'content=\"(\d+) followers', 1), '') AS BIGINT))",
}
_wall = {"youtube": "html LIKE '%log in%'", "tiktok": "html LIKE '%log in%' OR html = 'captcha'", "facebook": "html LIKE '%log in%'", "instagram": "html LIKE '%log in%'"}
_parsed_n = "CASE platform " + " ".join(f"WHEN '{p}' THEN {c}" for p, c in _count.items()) + " END"
_parsed_wall = "CASE platform " + " ".join(f"WHEN '{p}' THEN {c}" for p, c in _wall.items()) + " END"
_policy = "CASE platform " + " ".join(f"WHEN '{p}' THEN '{r}'" for p, (_, r) in dims.PLATFORM_POLICY.items() if r) + " END"
_parse_sql = f"""SELECT *, CASE WHEN n IS NOT NULL THEN 'known' WHEN skip IS NOT NULL THEN 'unsupported' WHEN wall THEN 'blocked' ELSE 'unknown' END AS state,
  CASE WHEN n IS NOT NULL THEN NULL WHEN skip IS NOT NULL THEN skip WHEN wall THEN CASE WHEN platform = 'youtube' OR html = 'captcha' THEN 'blocked_by_waf' ELSE 'platform_requires_auth' END ELSE 'no_count_in_markup' END AS reason,
  n IS NOT NULL AND ((platform = 'youtube' AND html LIKE '%"videoId"%') OR (platform = 'tiktok' AND html LIKE '%"videoCount": 3%')) AS video
  FROM (SELECT s.*, p.html, p.status, p.robots_blocked, {_parsed_n} AS n, {_parsed_wall} AS wall, {_policy} AS skip FROM fx_social s JOIN fx_profile p ON p.social_id = s.id)"""


# one saved page per address, that of the least account
_saved = "(SELECT profile_url, arg_min(html, social_id) AS html, arg_min(status, social_id) AS status FROM fx_profile GROUP BY profile_url)"


@query("C11_follower_snapshot", f"""SELECT id, profile_url, page_status, page_chars, n AS followers FROM (SELECT s.id, s.profile_url, p.status AS page_status, length(p.html) AS page_chars,
  {_parsed_n} AS n FROM (SELECT *, {_about} AS profile_url FROM fx_social WHERE platform IN ({", ".join(f"'{p}'" for p in _count)})) s LEFT JOIN {_saved} p USING (profile_url))""")
def _(t):
    saved = first_per_key(t.profile.withColumn("robots_blocked", F.col("robots_blocked") == 1), ["profile_url"], [F.col("social_id")])
    df = E.follower_snapshot(t.social.filter(F.col("platform").isin(list(_count))), saved)
    return df.select("id", "profile_url", "page_status", "page_chars", F.col("f.followers").alias("followers"))


@query("J16_followers_parse", f"SELECT id, n AS followers, state, reason, video AS has_video FROM ({_parse_sql})")
def _(t):
    df = t.social.select("id", "platform").join(t.profile.withColumnRenamed("social_id", "id"), "id")
    return C.add_followers(df, "platform", "html").select("id", "f.followers", "f.state", "f.reason", "f.has_video")


@query("J17_platform_policy", f"SELECT id, {_policy} IS NULL AS attempt, {_policy} AS policy_reason, CASE WHEN {_policy} = 'platform_tos_blocked' THEN 'blocked' WHEN {_policy} IS NOT NULL THEN 'unsupported' END AS policy_state FROM fx_social")
def _(t):
    return E.platform_policy(t.social).select("id", "attempt", "policy_reason", "policy_state")


@query("K5_follower_check_job", f"""SELECT id, CASE o WHEN 'kept' THEN followers WHEN 'ok' THEN n END AS followers,
  CASE o WHEN 'kept' THEN followers_state WHEN 'skipped' THEN CASE WHEN skip = 'platform_tos_blocked' THEN 'blocked' ELSE 'unsupported' END WHEN 'robots' THEN 'unknown' WHEN '429' THEN 'rate_limited' WHEN 'denied' THEN 'blocked'
    WHEN 'failed' THEN 'unknown' ELSE state END AS followers_state,
  CASE o WHEN 'kept' THEN followers_reason WHEN 'skipped' THEN skip WHEN 'robots' THEN 'robots_disallowed' WHEN '429' THEN 'rate_limited' WHEN 'denied' THEN 'blocked_by_waf' WHEN 'failed' THEN 'platform_requires_auth' ELSE reason END AS followers_reason, o AS outcome
  FROM (SELECT *, CASE WHEN manual_override IS NOT NULL THEN 'kept' WHEN skip IS NOT NULL THEN 'skipped' WHEN robots_blocked = 1 THEN 'robots' WHEN status = 429 THEN '429' WHEN status IN (401, 403) THEN 'denied'
    WHEN status IS NULL OR status >= 400 THEN 'failed' ELSE 'ok' END AS o FROM ({_parse_sql}))""")
def _(t):
    # one saved profile per account: the account id is part of both addresses
    socials = t.social.withColumn("url", F.concat("url", F.lit("?a="), F.col("id").cast("string")))
    profiles = t.profile.withColumns({"profile_url": F.regexp_replace("profile_url", "/about$", ""), "robots_blocked": F.col("robots_blocked") == 1})
    profiles = profiles.withColumn("profile_url", F.when(F.col("profile_url").contains("facebook.com"), F.concat("profile_url", F.lit("/about"))).otherwise(
        F.concat("profile_url", F.lit("?a="), F.col("social_id").cast("string"))))
    fb = F.col("platform") == "facebook"
    socials = socials.withColumn("url", F.when(fb, F.regexp_replace("url", r"\?a=(\d+)$", "-$1")).otherwise(F.col("url")))
    profiles = profiles.withColumn("profile_url", F.when(F.col("profile_url").endswith("/about"), F.concat(
        F.regexp_replace("profile_url", "/about$", ""), F.lit("-"), F.col("social_id").cast("string"), F.lit("/about"))).otherwise(F.col("profile_url")))
    return E.follower_check_job(socials, profiles).select("id", "followers", "followers_state", "followers_reason", "outcome")


# --------------------------------------------------------------- the chain
def pages_to_leads(t):
    """Saved homepages to a ranked lead table: verdict, contacts and profiles per page, summaries, score.

    The pages are read once: their facts and finds are written to the shared folder, and all
    further steps work on that narrow table.
    """
    from .queries_pages import pages

    path = f"{shared_dir(t.spark)}/page-facts-{uuid.uuid4().hex}"
    E.extract_pages(pages(t)).write.parquet(path)
    facts = t.spark.read.parquet(path)
    percent = F.round(F.col("confidence") * 100).cast("bigint").alias("confidence")
    owner = F.col("page_id").alias("business_id")
    emails = E.emails_of(facts, "page_id").select(owner, "address", "kind", percent, F.xxhash64("address").alias("id"))
    phones = E.phones_of(facts, "page_id").select(owner, "raw", "e164", percent, F.xxhash64("raw").alias("id"))
    socials = E.socials_of(facts, "page_id").select(
        owner, "platform", "url", F.lit(None).cast("bigint").alias("manual_override"), F.lit("not_attempted").alias("followers_state"),
        F.lit(None).cast("bigint").alias("followers"), F.lit(False).alias("has_video"))
    # each page is its own lead here, so its facts are already beside it and no join is needed
    leads = facts.select(F.col("page_id").alias("id"), F.col("url").alias("website_url"), F.col("host").alias("name"), F.col("probed_state").alias("site_state"),
                         F.lit(0).alias("hops"), F.col("probed_state").isin(dims.SCRAPEABLE_STATES).alias("scraped"))
    return L.scored(L.denorm(E.stage_derive(leads), phones, emails, socials))


_parseable = "(SELECT page_id FROM fx_page WHERE status IS NOT NULL AND content_type LIKE 'text/html%')"


def _chain_sql() -> str:
    from .queries_pages import _verdict

    return f"""SELECT id, site_state, has_phone, has_email, has_social, enrichment_stage, ({O.score()})::BIGINT AS score FROM (SELECT *,
      CASE WHEN site_state IN ('server_error', 'timeout') THEN 'probe' WHEN site_state IN ('live', 'live_weak', 'live_insecure') THEN 'contacts' WHEN site_state = 'too_many_redirects' THEN 'socials' ELSE 'socials' END AS enrichment_stage
      FROM (SELECT v.page_id AS id, CASE WHEN hops >= 5 THEN 'too_many_redirects' ELSE site_state END AS site_state, 'unknown' AS tier,
        v.page_id IN (SELECT page_id FROM ({_page_phones}) WHERE e164 IS NOT NULL AND page_id IN {_parseable}) AS has_phone,
        v.page_id IN (SELECT page_id FROM (SELECT page_id, {O.KIND} AS kind FROM ({_emails})) WHERE kind <> 'noreply' AND page_id IN {_parseable}) AS has_email,
        v.page_id IN (SELECT page_id FROM ({_socials}) WHERE page_id IN {_parseable}) AS has_social FROM ({_verdict}) v))"""


@query("K8_pages_to_leads", _chain_sql())
def _(t):
    return pages_to_leads(t).select("id", "site_state", "has_phone", "has_email", "has_social", "enrichment_stage", "score")


# ---------------------------------------------------------- sites as a whole
def site_tables(t) -> dict:
    """The inputs of a site enrichment: leads, pages as a probe sees them, what is known already, robots files and sitemaps."""
    from .queries_pages import probe_view

    saved = Workspace(t.spark, "saved-pages").written(probe_view(t.site_page), "pages")
    return {"leads": t.site, "pages": saved, "emails": t.site_email, "phones": t.site_phone, "socials": t.site_social,
            "robots": t.site_robots.withColumn("body", F.replace("body", F.lit("~"), F.lit("\n"))), "sitemaps": t.site_map}


@query("X1_site_enrichment")
def _(t):
    tables = enrich_sites(**site_tables(t))
    visits = tables["visits"].groupBy(F.col("business_id").alias("id")).agg(F.count("*").alias("n_visits"), F.count("page_id").alias("n_pages"))
    return tables["leads"].join(visits, "id", "left").select(
        "id", "site_state", "enrichment_stage", "email_state", "has_phone", "has_email", "has_social", "email", "phone_e164", "score", "n_visits", "n_pages")
