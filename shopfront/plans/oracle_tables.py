"""Intermediate tables of the DuckDB side of a comparison, written independently of the Spark code."""
from __future__ import annotations

from .. import dims


def values(name: str) -> str:
    """A reference table as a DuckDB VALUES list."""
    schema, rows = dims.tables()[name]
    lit = lambda v: ("NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int)
                     else "'" + v.replace("'", "''") + "'")
    cols = ", ".join(c.split()[0] for c in schema.split(", "))
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS {name}({cols})"


def rlist(items) -> str:
    return "(" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + ")"


KNOWN = "coalesce(manual_override, CASE WHEN followers_state = 'known' THEN followers END)"
PCT = ("(70 + CASE WHEN site_state IN ('unknown', 'has_tag_unprobed') THEN 0 ELSE 15 END"
       " + CASE WHEN enrichment_stage IN ('contacts', 'socials', 'done') THEN 9 ELSE 0 END"
       " + CASE WHEN enrichment_stage IN ('socials', 'done') THEN 6 ELSE 0 END)")
CONTACT = ("least(30, CASE WHEN has_phone THEN 12 ELSE 0 END + CASE WHEN has_email THEN 12 ELSE 0 END"
           " + CASE WHEN has_social THEN 6 ELSE 0 END)")
PRESENCE = ("least(15, CASE WHEN has_social THEN 8 ELSE 0 END + CASE tier WHEN 'under500' THEN 1 WHEN 'under2k' THEN 3"
            " WHEN 'under10k' THEN 5 WHEN 'atLeast10k' THEN 7 ELSE 0 END)")
REASONS = (
    "concat_ws('|', CASE site_state " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.STATE_REASONS.items())
    + " ELSE 'website state unknown' END, CASE WHEN has_phone THEN 'phone found' END,"
    " CASE WHEN has_email THEN 'email found' END, CASE WHEN has_social THEN 'social presence found' END,"
    " CASE WHEN tier = 'unknown' THEN 'follower count not available' END,"
    f" CASE WHEN {PCT} < 100 THEN 'partially checked' END)"
)


def gap(preset: str) -> str:
    points = {**dims.SITE_POINTS, **dims.PRESET_POINTS[preset]}
    return "CASE site_state " + " ".join(f"WHEN '{s}' THEN {n}" for s, n in points.items()) + " ELSE 10 END"


def score(preset: str = "websites") -> str:
    return f"greatest(0, least(100, (({gap(preset)} + {CONTACT} + {PRESENCE}) * {PCT} + 50) // 100))"


DERIVED: dict[str, str] = {}
DERIVED["or_denorm"] = f"""
SELECT b.*, coalesce(p.n, 0) > 0 AS has_phone, coalesce(e.n, 0) > 0 AS has_email, s.business_id IS NOT NULL AS has_social,
  e.email, p.phone_e164, p.phone_raw, coalesce(s.followers_known, 0) AS followers_known, s.followers_total,
  coalesce(s.video_platforms, 0) AS video_platforms,
  CASE WHEN s.top IS NULL THEN 'unknown' WHEN s.top < 500 THEN 'under500' WHEN s.top < 2000 THEN 'under2k'
       WHEN s.top < 10000 THEN 'under10k' ELSE 'atLeast10k' END AS tier,
  b.website_url IS NOT NULL AND b.site_state NOT IN ('no_tag', 'social_only') AS has_website
FROM fx_business b
LEFT JOIN (SELECT business_id, count(e164) AS n,
    (array_agg(e164 ORDER BY confidence DESC, id) FILTER (WHERE e164 IS NOT NULL))[1] AS phone_e164,
    (array_agg(raw ORDER BY confidence DESC, id))[1] AS phone_raw FROM fx_phone GROUP BY business_id) p ON p.business_id = b.id
LEFT JOIN (SELECT business_id, count(*) FILTER (WHERE kind <> 'noreply') AS n,
    (array_agg(address ORDER BY CASE kind WHEN 'role' THEN 0 WHEN 'personal' THEN 1 ELSE 2 END, confidence DESC, id))[1] AS email
    FROM fx_email GROUP BY business_id) e ON e.business_id = b.id
LEFT JOIN (SELECT business_id, count({KNOWN}) AS followers_known, sum({KNOWN})::BIGINT AS followers_total, max({KNOWN}) AS top,
    count(*) FILTER (WHERE has_video) AS video_platforms FROM fx_social GROUP BY business_id) s ON s.business_id = b.id"""
DERIVED["or_lead"] = f"SELECT *, ({score()})::BIGINT AS score, {PCT} AS confidence_pct, {REASONS} AS reasons FROM or_denorm"
DERIVED["or_daily"] = """
SELECT day, sum(CASE WHEN m = 'tasks_created' THEN n ELSE 0 END)::BIGINT AS tasks_created,
  sum(CASE WHEN m = 'tasks_done' THEN n ELSE 0 END)::BIGINT AS tasks_done,
  sum(CASE WHEN m = 'leads_found' THEN n ELSE 0 END)::BIGINT AS leads_found,
  sum(CASE WHEN m = 'contacted' THEN n ELSE 0 END)::BIGINT AS contacted,
  sum(CASE WHEN m = 'replied' THEN n ELSE 0 END)::BIGINT AS replied,
  sum(CASE WHEN m = 'won' THEN n ELSE 0 END)::BIGINT AS won, sum(CASE WHEN m = 'lost' THEN n ELSE 0 END)::BIGINT AS lost
FROM (
  SELECT day, 'tasks_created' AS m, count(*) AS n FROM fx_activity WHERE kind = 'task_created' GROUP BY day
  UNION ALL SELECT day, json_extract_string(meta, '$.toStage'), count(*) FROM fx_activity
    WHERE kind = 'stage_change' AND json_extract_string(meta, '$.toStage') IN ('contacted', 'replied', 'won', 'lost') GROUP BY 1, 2
  UNION ALL SELECT done_at::DATE, 'tasks_done', count(*) FROM fx_task WHERE done_at IS NOT NULL GROUP BY 1
  UNION ALL SELECT first_seen_at::DATE, 'leads_found', count(*) FROM fx_business GROUP BY 1) x
GROUP BY day"""


# ------------------------------------------------------------------ URLs
TRACK = "(?i)(" + "|".join(dims.TRACKING_PARAMS) + ")"
SHARE = "(?i)(" + "|".join(dims.SHARE_PATHS) + ")"


def mapping(expr: str, table: dict) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def encode(expr: str) -> str:
    """Percent-encoding of the characters a browser would encode, one character at a time."""
    return (f"array_to_string(list_transform(string_split({expr}, ''), lambda c: CASE WHEN regexp_matches(c, '[^\\x21-\\x7e]|[\"<>`{{}}]')"
            " THEN url_encode(c) ELSE c END), '')")


def url_parts(src: str, col: str) -> str:
    """Adds u_scheme, u_host, u_port, u_path, u_query to a source."""
    trimmed = rf"regexp_replace({col}, '^\s+|\s+$', '', 'g')"
    full = (rf"CASE WHEN coalesce({trimmed}, '') = '' OR regexp_matches({trimmed}, '(?i)^(mailto:|tel:|javascript:|#)') THEN NULL"
            rf" WHEN regexp_matches({trimmed}, '(?i)^https?://') THEN {trimmed} ELSE 'https://' || {trimmed} END")
    auth = r"regexp_replace(regexp_extract(u_full, '^(?i:https?)://([^/?#\\]*)', 1), '^.*@', '')"
    one = f"SELECT *, {full} AS u_full FROM {src}"
    two = rf"""SELECT *, lower(regexp_extract(u_full, '^([A-Za-z]+):', 1)) AS u_sch, lower(regexp_replace({auth}, ':\d*$', '')) AS u_h,
      regexp_extract({auth}, ':(\d+)$', 1) AS u_p, regexp_extract(u_full, '^(?i:https?)://[^/?#\\]*([^?#]*)', 1) AS u_pa,
      regexp_extract(u_full, '^[^?#]*(\?[^#]*)', 1) AS u_q FROM ({one})"""
    ok = r"(u_full IS NOT NULL AND regexp_matches(u_h, '^[^\s%<>\[\]^|:]+$'))"
    return rf"""SELECT * EXCLUDE (u_full, u_sch, u_h, u_p, u_pa, u_q), CASE WHEN {ok} THEN u_sch END AS u_scheme, CASE WHEN {ok} THEN u_h END AS u_host,
      CASE WHEN {ok} THEN CASE WHEN u_p = '' OR (u_sch = 'https' AND u_p = '443') OR (u_sch = 'http' AND u_p = '80') THEN '' ELSE ':' || u_p END END
      AS u_port, CASE WHEN {ok} THEN CASE WHEN u_pa = '' THEN '/' ELSE {encode('u_pa')} END END AS u_path,
      CASE WHEN {ok} THEN {encode('u_q')} END AS u_query FROM ({two})"""


PARAMS = r"list_filter(string_split(regexp_replace(u_query, '^\?', ''), '&'), lambda p: p <> '')"
KEPT = rf"list_filter({PARAMS}, lambda p: NOT regexp_matches(string_split(p, '=')[1], '{TRACK}'))"


def query_text(params: str) -> str:
    return (f"CASE WHEN len({params}) > 0 THEN '?' || array_to_string(list_transform({params}, lambda p: CASE WHEN contains(p, '=') THEN p"
            " ELSE p || '=' END), '&') ELSE '' END")


def domain(host: str) -> str:
    last = lambda n: f"array_to_string(string_split({host}, '.')[-{n}:], '.')"
    return (rf"CASE WHEN regexp_matches({host}, '^\d+(\.\d+){{3}}$') OR NOT contains({host}, '.') THEN NULL WHEN {last(2)} IN {rlist(dims.TWO_LABEL_SUFFIXES)}"
            rf" THEN CASE WHEN len(string_split({host}, '.')) > 2 THEN {last(3)} END ELSE {last(2)} END")


def under(host: str, names: list[str]) -> str:
    return "(" + " OR ".join(f"{host} = '{n}' OR ends_with({host}, '.{n}')" for n in names) + ")"


HANDLE = r"""CASE WHEN n_platform IS NULL OR len(segs) = 0 THEN NULL
  WHEN n_platform IN ('instagram', 'threads') THEN CASE WHEN segs[1] NOT IN ('p', 'reel', 'reels', 'explore', 'stories', 'tv') THEN lower(segs[1]) END
  WHEN n_platform = 'facebook' THEN CASE WHEN segs[1] NOT IN ('pages', 'groups', 'profile.php', 'people') THEN lower(segs[1]) END
  WHEN n_platform = 'tiktok' THEN nullif(lower(regexp_replace(segs[1], '^@', '')), '')
  WHEN n_platform = 'twitter' THEN CASE WHEN segs[1] NOT IN ('i', 'home', 'search', 'hashtag', 'intent') THEN lower(segs[1]) END
  WHEN n_platform = 'linkedin' THEN CASE WHEN segs[1] IN ('company', 'in', 'school', 'showcase') AND len(segs) > 1 THEN lower(segs[1] || '/' || segs[2]) END
  WHEN n_platform = 'youtube' THEN CASE WHEN starts_with(segs[1], '@') THEN lower(segs[1])
    WHEN segs[1] IN ('channel', 'c', 'user') AND len(segs) > 1 THEN lower(segs[1] || '/' || segs[2]) END
  WHEN n_platform = 'whatsapp' THEN nullif(regexp_replace(segs[1], '\D', '', 'g'), '')
  WHEN n_platform IN ('telegram', 'pinterest') THEN lower(segs[1]) END"""


def identity(src: str, col: str) -> str:
    """Adds the n_ columns of a normalised URL to a source."""
    one = f"""SELECT *, CASE WHEN contains(regexp_replace(u_host, '^www\\.', ''), '.') THEN regexp_replace(u_host, '^www\\.', '') END AS n_host,
      list_filter(string_split(u_path, '/'), lambda s: s <> '') AS segs FROM ({url_parts(src, col)})"""
    two = f"""SELECT *, {domain('n_host')} AS n_domain, coalesce({mapping('n_host', dims.SOCIAL_HOSTS)},
      {mapping('(' + domain('n_host') + ')', dims.SOCIAL_HOSTS)}) AS n_platform FROM ({one})"""
    query = f"CASE WHEN len({KEPT}) = len({PARAMS}) THEN u_query ELSE {query_text(KEPT)} END"
    return f"""SELECT * EXCLUDE (segs, u_scheme, u_host, u_port, u_path, u_query),
      CASE WHEN n_host IS NOT NULL THEN u_scheme || '://' || u_host || u_port || u_path || {query} END AS n_url,
      coalesce(n_host IN {rlist(dims.LINK_HUB_HOSTS)} OR n_domain IN {rlist(dims.LINK_HUB_HOSTS)}, false) AS n_is_hub,
      CASE WHEN {under('n_host', dims.FREE_HOST_SUFFIXES)} THEN n_host ELSE coalesce(n_domain, n_host) END AS n_dedupe_key,
      n_platform IS NOT NULL AS n_is_social, {HANDLE} AS n_handle,
      coalesce(n_platform IS NOT NULL AND regexp_matches(u_path, '{SHARE}'), false) AS n_share FROM ({two})"""


# ------------------------------------------------------------------ POIs
multi = lambda e: f"coalesce(list_filter(list_transform(string_split({e}, ';'), lambda v: trim(v)), lambda v: v <> ''), [])"
_cat_case = lambda field: "CASE " + " ".join(
    f"WHEN tag_key = '{k}' AND trim(string_split(tag_value, ';')[1]) IN {rlist(v)} THEN '{c[field]}'"
    for c in dims.CATEGORIES for k, v in c[2]) + f" ELSE '{('other', 'Other')[field]}' END"
ALIVE = ("coalesce(trim(t_name), '') <> '' AND t_was_shop IS NULL AND (t_disused IS NULL OR lower(trim(t_disused)) IN ('no', 'false', '0'))"
         " AND NOT coalesce(regexp_matches(t_lifecycle, '(?i)disused|abandoned|demolished|construction'), false)")
NAME = ("trim(regexp_replace(regexp_replace(lower(strip_accents({0})), '\\b(" + "|".join(dims.LEGAL_WORDS) + ")\\b\\.?', '', 'g'), '[^a-z0-9]+', ' ', 'g'))")
DERIVED["or_poi"] = f"""
SELECT *, CASE WHEN n_url IS NOT NULL AND NOT n_is_social AND NOT n_is_hub THEN 'has_tag_unprobed'
    WHEN (n_url IS NOT NULL AND n_is_social) OR t_instagram LIKE 'http%' OR t_x IS NOT NULL THEN 'social_only' ELSE 'no_tag' END AS site_state,
  CASE WHEN n_url IS NOT NULL AND NOT n_is_social AND NOT n_is_hub THEN n_url END AS website_url,
  CASE WHEN n_url IS NOT NULL AND NOT n_is_social AND NOT n_is_hub THEN n_domain END AS website_domain,
  coalesce(n_dedupe_key, address_line, name_normalized) AS dedupe_key, phones[1] AS phone_raw
FROM ({identity(f'''(SELECT *, type || '/' || id AS osm_key, trim(t_name) AS name, {NAME.format('trim(t_name)')} AS name_normalized,
    {_cat_case(0)} AS category, {_cat_case(1)} AS category_label, {multi('t_website')}[1] AS website,
    list_filter(list_concat({multi('t_phone')}, {multi('t_mobile')}), lambda v, i: list_position(list_concat({multi('t_phone')}, {multi('t_mobile')}), v) = i) AS phones,
    {multi('t_email')} AS emails, nullif(trim(t_street), '') AS street, nullif(trim(t_housenumber), '') AS house_number,
    coalesce(nullif(trim(concat_ws(' ', t_housenumber, trim(t_street))), ''), t_full) AS address_line, coalesce(t_city, t_town, t_village) AS city,
    lower(trim(t_country)) AS country_code, t_postcode AS postcode FROM fx_poi_cols WHERE {ALIVE})''', 'website')})"""
DERIVED["or_poi_social"] = f"""SELECT osm_key, platform, n_url AS url, n_handle AS handle FROM ({identity(f'''(
  SELECT osm_key, 'instagram' AS platform, unnest({multi('t_instagram')}) AS raw FROM or_poi UNION ALL
  SELECT osm_key, 'twitter', unnest({multi('t_x')}) FROM or_poi)''', 'raw')}) WHERE n_url IS NOT NULL"""

# ---------------------------------------------------------------- phones
DIGITS = lambda e: rf"regexp_replace({e}, '\D', '', 'g')"
TIDY = lambda e: rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({e}, '(?i)^tel:', ''), '[^\d+().\-\s/]', '', 'g'), '\s{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g')"
NOISE = lambda e: (rf"(regexp_matches({e}, '^\d{{4}}$|^\d{{1,3}}(\.\d+)?$|^\d{{1,2}}[:.]\d{{2}}(\s*[-–]\s*\d{{1,2}}[:.]\d{{2}})?$')"
                   rf" OR (regexp_matches({e}, '\b(19|20)\d{{2}}\b') AND length({DIGITS(e)}) <= 4))")


def phones(src: str, raw: str, country: str) -> str:
    """Adds e164, is_mobile and reject_reason to a source with a unique `rid`."""
    fits = lambda nat: f"length(CASE WHEN c.region IN {rlist(dims.NO_TRUNK_ZERO)} THEN {nat} ELSE regexp_replace({nat}, '^0', '') END)"
    cut = lambda nat: f"CASE WHEN c.region IN {rlist(dims.NO_TRUNK_ZERO)} THEN {nat} ELSE regexp_replace({nat}, '^0', '') END"
    base = f"""SELECT *, {TIDY(raw)} AS t_clean, regexp_matches({TIDY(raw)}, '^(\\+|00)') AS t_int,
      {DIGITS(f"regexp_replace({TIDY(raw)}, '^00', '')")} AS t_dig, {DIGITS(TIDY(raw))} AS t_nat, upper({country}) AS t_reg FROM {src}"""
    tries = f"""SELECT b.rid, 1 AS o, c.code, {cut('b.t_nat')} AS nat, c.mobile FROM ({base}) b JOIN {values('calling_code').replace(' AS calling_code', ' AS c')}
        ON NOT b.t_int AND c.region = b.t_reg WHERE {fits('b.t_nat')} BETWEEN c.min_len AND c.max_len
      UNION ALL SELECT b.rid, 2, c.code, {cut("substr(b.t_dig, length(c.code) + 1)")}, c.mobile FROM ({base}) b JOIN
        {values('calling_code').replace(' AS calling_code', ' AS c')} ON starts_with(b.t_dig, c.code)
        WHERE {fits("substr(b.t_dig, length(c.code) + 1)")} BETWEEN c.min_len AND c.max_len"""
    best = f"SELECT rid, arg_min(code, o) AS code, arg_min(nat, o) AS nat, arg_min(mobile, o) AS mobile FROM ({tries}) GROUP BY rid"
    bad = f"(length({DIGITS('t_clean')}) NOT BETWEEN 7 AND 17 OR {NOISE('t_clean')})"
    return f"""SELECT b.* EXCLUDE (t_int, t_dig, t_nat, t_reg), CASE WHEN NOT {bad} THEN '+' || x.code || x.nat END AS e164,
      coalesce(NOT {bad} AND CASE WHEN x.mobile = '' THEN x.code = '1' ELSE regexp_matches(x.nat, x.mobile) END, false) AS is_mobile,
      CASE WHEN length({DIGITS('t_clean')}) NOT BETWEEN 7 AND 17 THEN 'too_few_digits' WHEN {NOISE('t_clean')} THEN 'not_a_phone'
        WHEN x.code IS NOT NULL THEN NULL WHEN t_int OR t_reg IS NOT NULL THEN 'unparseable' ELSE 'country_unknown' END AS reject_reason
      FROM ({base}) b LEFT JOIN ({best}) x USING (rid)"""


DERIVED["or_poi_phone"] = f"""SELECT osm_key, ord, raw, e164, is_mobile, (CASE WHEN e164 IS NULL THEN 50 ELSE 70 END)::BIGINT AS confidence, reject_reason
  FROM ({phones('''(SELECT *, osm_key || '#' || ord AS rid FROM (SELECT osm_key, country_code, unnest(phones) AS raw, generate_subscripts(phones, 1) - 1 AS ord FROM or_poi))''',
                'raw', 'country_code')})"""

# ----------------------------------------------------------------- pages
RE = lambda s: s.replace("'", "''")
BODY_TEXT = (r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g'),"
             r" '(?is)^.*?<body[^>]*>', ''), '<[^>]*>', '', 'g')")


def entities(e: str) -> str:
    for a, b in [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&#39;", "''"), ("&#64;", "@"), ("&commat;", "@"),
                 ("&#46;", "."), ("&period;", "."), ("&amp;", "&")]:
        e = f"replace({e}, '{a}', '{b}')"
    return e


def plausible(a: str) -> str:
    local, dom = f"regexp_extract({a}, '^(.*)@([^@]*)$', 1)", f"lower(regexp_extract({a}, '^(.*)@([^@]*)$', 2))"
    return (rf"(regexp_matches({local}, '(?i)^[a-z0-9._%+-]{{1,64}}$') AND length({dom}) <= 253 AND {dom} NOT IN {rlist(dims.REJECT_EMAIL_DOMAINS)}"
            rf" AND NOT regexp_matches(lower({a}), '{dims.FILE_EXTENSION}') AND NOT regexp_matches({local}, '(?i)^[0-9a-f]{{16,}}$|^\d+$')"
            rf" AND regexp_matches({dom}, '^[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z0-9-]{{2,}}$'))")


def find_emails(e: str) -> str:
    found = f"list_transform(regexp_extract_all({e}, '(?i){dims.EMAIL_PATTERN}'), lambda a: regexp_replace(lower(a), '[.,;:]+$', ''))"
    kept = f"list_filter({found}, lambda a: {plausible('a')})"
    return f"list_filter({kept}, lambda v, i: list_position({kept}, v) = i)"


KIND = (f"CASE WHEN regexp_matches(split_part(address, '@', 1), '{dims.NOREPLY_MAILBOX}') THEN 'noreply'"
        f" WHEN split_part(address, '@', 1) IN {rlist(dims.ROLE_MAILBOXES)} OR regexp_matches(split_part(address, '@', 1), '{dims.ROLE_MAILBOX_PREFIX}')"
        " THEN 'role' ELSE 'personal' END")
HREFS = rf"""list_transform(regexp_extract_all(html, '(?is)<a\s[^>]*?\bhref\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), lambda h: {entities("regexp_replace(h, '^[\"'']|[\"'']$', '', 'g')")})"""
DERIVED["or_page_text"] = f"SELECT page_id, url, {entities(BODY_TEXT)} AS body_text, {HREFS} AS hrefs FROM fx_page"
_ld = r"regexp_extract_all(html, '(?is)<script\b[^>]*\btype\s*=\s*[\"'']application/ld\+json[\"''][^>]*>(.*?)</script', 1)"
DERIVED["or_ld"] = f"""SELECT page_id, s::JSON AS j FROM (SELECT page_id, unnest({_ld}) AS s FROM fx_page) WHERE json_valid(s)"""
KIND_SWAPPED = KIND.replace("address", "replace(address, 'info', 'book-it')")
