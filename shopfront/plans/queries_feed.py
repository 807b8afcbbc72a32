"""Score, feed, joins and edits of the lead table."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import score as S
from ..operators import duplicates as D
from ..operators import edits as E
from ..operators import leads as L
from ..sources import tables as T
from ..operators.workspace import Workspace
from . import oracle_tables as O
from .fixtures import NOW
from .registry import query

micros = lambda c: F.unix_micros(F.col(c)).alias(c)

# ------------------------------------------------------------- scoring


@query("I1_web_gap", "SELECT id, " + ", ".join(f"({O.gap(p)})::BIGINT AS gap_{p}" for p in dims.PRESET_POINTS) + " FROM fx_business")
def _(t):
    return t.business.select("id", *(S.web_gap(p).cast("bigint").alias(f"gap_{p}") for p in dims.PRESET_POINTS))


@query("I2_contactability", f"SELECT id, ({O.CONTACT})::BIGINT AS points FROM or_denorm")
def _(t):
    return t.denorm().select("id", S.contactability().cast("bigint").alias("points"))


@query("I3_presence", f"SELECT id, ({O.PRESENCE})::BIGINT AS points FROM or_denorm")
def _(t):
    return t.denorm().select("id", S.presence().cast("bigint").alias("points"))


@query("I4_magnitude_tier", f"""SELECT id, CASE WHEN k IS NULL THEN 'unknown' WHEN k < 500 THEN 'under500' WHEN k < 2000 THEN 'under2k'
  WHEN k < 10000 THEN 'under10k' ELSE 'atLeast10k' END AS tier FROM (SELECT id, {O.KNOWN} AS k FROM fx_social)""")
def _(t):
    return t.social.select("id", S.magnitude_tier(S.known_followers()).alias("tier"))


@query("I5_coverage", """SELECT id, site_state NOT IN ('unknown', 'has_tag_unprobed') AS website_probed,
  enrichment_stage IN ('contacts', 'socials', 'done') AS contacts_extracted, enrichment_stage IN ('socials', 'done') AS socials_checked
  FROM fx_business""")
def _(t):
    return t.business.select("id", *(c.alias(n) for n, c in S.coverage().items()))


@query("I6_confidence", f"SELECT id, {O.PCT}::BIGINT AS pct FROM fx_business")
def _(t):
    return t.business.select("id", S.confidence_pct().cast("bigint").alias("pct"))


@query("I7_score", "SELECT id, " + ", ".join(f"({O.score(p)})::BIGINT AS score_{p}" for p in dims.PRESET_POINTS) + " FROM or_denorm")
def _(t):
    return t.denorm().select("id", *(S.score(p).alias(f"score_{p}") for p in dims.PRESET_POINTS))


@query("I8_reasons", "SELECT id, reasons FROM or_lead")
def _(t):
    return t.denorm().select("id", F.array_join(S.score_reasons(), "|").alias("reasons"))


@query("I9_rescore_all", f"""SELECT id, ({O.score('balanced')})::BIGINT AS score, {O.PCT}::BIGINT AS pct, {O.REASONS} AS reasons,
  1::BIGINT AS score_version, epoch_us(TIMESTAMP '{NOW}') AS scored_at FROM or_denorm""")
def _(t):
    df = L.rescore_all(t.denorm(), "balanced", now=NOW)
    return df.select("id", "score", F.col("confidence_pct").cast("bigint").alias("pct"), F.array_join("score_reasons", "|").alias("reasons"),
                     F.col("score_version").cast("bigint").alias("score_version"), micros("scored_at"))


@query("I10_preset_compare", "SELECT id, preset, score, rank() OVER (PARTITION BY preset ORDER BY score DESC) AS rank FROM ("
       + " UNION ALL ".join(f"SELECT id, '{p}' AS preset, ({O.score(p)})::BIGINT AS score FROM or_denorm" for p in dims.PRESET_POINTS) + ")")
def _(t):
    return L.preset_compare(t.denorm())


def _grid() -> str:
    lit = lambda name, col, items: f"(VALUES {', '.join(f'({chr(39)}{i}{chr(39)})' for i in items)}) AS {name}({col})"
    flags = ("(VALUES (false,false,false),(true,false,false),(false,true,false),(true,true,false),(true,true,true),(false,false,true))"
             " AS f(has_phone, has_email, has_social)")
    base = (f"(SELECT * FROM {lit('s', 'site_state', dims.SITE_STATES)}, {flags}, {lit('t', 'tier', dims.TIER_POINTS)},"
            f" {lit('e', 'enrichment_stage', dims.ENRICHMENT_STAGES)})")
    return " UNION ALL ".join(f"SELECT '{p}' AS preset, *, ({O.score(p)})::BIGINT AS score FROM {base}" for p in dims.PRESET_POINTS)


@query("I11_score_grid", f"""SELECT g.preset, g.site_state, g.tier, g.enrichment_stage, g.has_phone, g.has_email, g.has_social,
  g.score, count(l.id) AS n_leads FROM ({_grid()}) g LEFT JOIN or_denorm l
  USING (site_state, tier, enrichment_stage, has_phone, has_email, has_social) GROUP BY ALL""")
def _(t):
    keys = ["site_state", "tier", "enrichment_stage", "has_phone", "has_email", "has_social"]
    counts = t.denorm().groupBy(*keys).agg(F.count("*").alias("n_leads"))
    df = L.score_grid(t.spark).join(counts, keys, "left")
    return df.select("preset", *keys, "score", F.coalesce("n_leads", F.lit(0)).alias("n_leads"))


@query("D13_stale_scores", "SELECT count(*) AS n FROM fx_business WHERE score_version IS DISTINCT FROM 1 OR scored_at IS NULL")
def _(t):
    return L.stale_scores(t.business)


# ------------------------------------------------- child summaries, joins
DENORM_COLS = ["id", "has_phone", "has_email", "has_social", "email", "phone_e164", "phone_raw", "followers_known", "followers_total",
               "video_platforms", "tier", "has_website"]


@query("D1_denorm_refresh", f"SELECT {', '.join(DENORM_COLS)} FROM or_denorm")
def _(t):
    return t.denorm().select(*DENORM_COLS)


@query("D2_known_followers", f"SELECT id, {O.KNOWN} AS known FROM fx_social")
def _(t):
    return t.social.select("id", S.known_followers().alias("known"))


@query("E1_primary_email", """SELECT business_id, address AS email FROM fx_email QUALIFY row_number() OVER (PARTITION BY business_id
  ORDER BY CASE kind WHEN 'role' THEN 0 WHEN 'personal' THEN 1 ELSE 2 END, confidence DESC, id) = 1""")
def _(t):
    return L.primary_email(t.email)


@query("E2_primary_phone", """SELECT r.business_id, e.e164 AS phone_e164, r.raw AS phone_raw FROM
  (SELECT * FROM fx_phone QUALIFY row_number() OVER (PARTITION BY business_id ORDER BY confidence DESC, id) = 1) r LEFT JOIN
  (SELECT * FROM fx_phone WHERE e164 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY business_id ORDER BY confidence DESC, id) = 1) e
  USING (business_id)""")
def _(t):
    return L.primary_phone(t.phone)


@query("C1_lead_socials", """SELECT l.id, l.score, s.platform, s.handle, s.url FROM
  (SELECT * FROM or_lead ORDER BY score DESC, has_phone::INT + has_email::INT DESC, name, id LIMIT 100) l
  LEFT JOIN fx_social s ON s.business_id = l.id""")
def _(t):
    page, _total = L.feed_page(t.leads(), 1, 100)
    return L.lead_socials(page.select("id", "score"), t.social).select("id", "score", "platform", "handle", "url")


@query("C4_has_child", """SELECT id, EXISTS (SELECT 1 FROM fx_phone p WHERE p.business_id = b.id AND e164 IS NOT NULL) AS has_phone,
  EXISTS (SELECT 1 FROM fx_email e WHERE e.business_id = b.id AND kind <> 'noreply') AS has_email,
  EXISTS (SELECT 1 FROM fx_social s WHERE s.business_id = b.id) AS has_social FROM fx_business b""")
def _(t):
    return L.has_child(t.business.select("id"), t.phone, t.email, t.social)


@query("C6_lead_detail", """SELECT b.id, (SELECT count(*) FROM fx_email x WHERE x.business_id = b.id) AS n_emails,
  (SELECT count(*) FROM fx_phone x WHERE x.business_id = b.id) AS n_phones, (SELECT count(*) FROM fx_social x WHERE x.business_id = b.id) AS n_socials,
  coalesce((SELECT string_agg(id::VARCHAR, ',' ORDER BY created_at DESC, id DESC) FROM (SELECT * FROM fx_task k WHERE k.business_id = b.id
    ORDER BY created_at DESC, id DESC LIMIT 50)), '') AS tasks,
  CASE WHEN parking_evidence LIKE '[%' THEN array_to_string(from_json(parking_evidence, '["VARCHAR"]'), '|') ELSE '' END AS evidence
  FROM fx_business b""")
def _(t):
    df = L.lead_detail(t.business, t.phone, t.email, t.social, t.task)
    ids = F.transform("tasks", lambda x: x["task_id"].cast("string"))
    return df.select("id", "n_emails", "n_phones", "n_socials", F.array_join(ids, ",").alias("tasks"), F.array_join("evidence", "|").alias("evidence"))


@query("C6_lead_children", """SELECT business_id, 'email' AS kind, address AS value, confidence FROM fx_email UNION ALL
  SELECT business_id, 'phone', coalesce(e164, raw), confidence FROM fx_phone UNION ALL SELECT business_id, 'social', url, NULL FROM fx_social""")
def _(t):
    return L.lead_children(t.phone, t.email, t.social)


@query("E5_recent_tasks", """SELECT id, business_id FROM fx_task WHERE business_id IS NOT NULL QUALIFY row_number() OVER
  (PARTITION BY business_id ORDER BY created_at DESC, id DESC) <= 50""")
def _(t):
    from ..operators.ordered import top_per_key

    tasks = t.task.filter("business_id IS NOT NULL")
    return top_per_key(tasks, ["business_id"], [F.col("created_at").desc(), F.col("id").desc()], 50).select("id", "business_id")


# ------------------------------------------------------ filter and search
@query("B14_lead_filter", """SELECT id, 'website' AS f FROM or_lead WHERE site_state IN ('no_tag', 'social_only', 'dead', 'parked', 'server_down')
    AND has_phone AND score >= 40 UNION ALL
  SELECT id, 'stage' FROM or_lead WHERE category = 'trades' AND pipeline_stage = 'won' AND has_email AND has_social UNION ALL
  SELECT id, 'states' FROM or_lead WHERE site_state IN ('live', 'parked')""")
def _(t):
    leads = t.leads()
    tagged = lambda df, f: df.select("id", F.lit(f).alias("f"))
    return tagged(L.lead_filter(leads, category="all", no_website=True, has_phone=True, min_score=40), "website").unionByName(
        tagged(L.lead_filter(leads, category="trades", stage="won", has_email=True, has_social=True), "stage")).unionByName(
        tagged(L.lead_filter(leads, site_states=["live", "parked"]), "states"))


def _search(q: list[str]) -> str:
    tokens = "string_split_regex(lower(name || ' ' || coalesce(address_line, '')), '[^a-z0-9]+')"
    return " AND ".join(f"len(list_filter({tokens}, lambda x: starts_with(x, '{w}'))) > 0" for w in q)


@query("B15_lead_search", f"""SELECT id, 'words' AS q FROM fx_business WHERE {_search(['plumb', 'heat', '2'])} UNION ALL
  SELECT id, 'address' FROM fx_business WHERE {_search(['high', 'cafe'])} UNION ALL
  SELECT id, 'signs' FROM fx_business WHERE name ILIKE '%&%' UNION ALL
  SELECT id, 'wild' FROM fx_business WHERE name ILIKE '%_%'""")
def _(t):
    cases = {"words": "Plumb & heat! 2", "address": "HIGH café", "signs": "&", "wild": " _ "}
    out = None
    for name, q in cases.items():
        df = L.lead_search(t.business, q).select("id", F.lit(name).alias("q"))
        out = df if out is None else out.unionByName(df)
    return out


_words = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"


@query("B15_lead_search_batch", f"""SELECT query_id, id FROM (SELECT query_id, trim(q) AS q, {_words.format('q')} AS begins FROM fx_search) s JOIN
  (SELECT id, name, {_words.format("name || ' ' || coalesce(address_line, '')")} AS words FROM fx_business) b ON CASE WHEN len(begins) = 0 THEN name ILIKE '%' || q || '%'
  ELSE len(list_filter(begins, lambda w: len(list_filter(words, lambda x: starts_with(x, w))) = 0)) = 0 END""")
def _(t):
    from ..operators.lead_index import LeadIndex

    return LeadIndex(t.spark, Workspace(t.spark, "lead-index").path).build(t.business).search(t.search)


FEED_COLS = ["id", "name", "score", "has_website", "phone", "email", "has_video", "followers_total", "pipeline_stage"]


@query("B16_lead_projection", """SELECT id, name, score, has_website, coalesce(phone_e164, phone_raw) AS phone, email,
  video_platforms > 0 AS has_video, followers_total, pipeline_stage FROM or_lead""")
def _(t):
    return L.lead_projection(t.leads()).select(*FEED_COLS)


SQL_ORDER = {
    "score": "score DESC, has_phone::INT + has_email::INT DESC, name, id", "name": "name, id", "recent": "first_seen_at DESC, id",
    "followers": "followers_total DESC NULLS LAST, score DESC, id",
}


@query("F1_feed_sort", " UNION ALL ".join(f"SELECT * FROM (SELECT '{s}' AS sort, id, score, name FROM or_lead)"
                                          for s, o in SQL_ORDER.items()))
def _(t):
    # scored once, then read in each order
    out, leads = None, Workspace(t.spark, "scored-leads").written(t.leads(), "leads")
    for sort in SQL_ORDER:
        df = L.feed_sort(leads, sort).select(F.lit(sort).alias("sort"), "id", "score", "name")
        out = df if out is None else out.unionByName(df)
    return out


@query("F2_feed_page", f"SELECT p.id, p.score, t.total FROM (SELECT * FROM or_lead ORDER BY {SQL_ORDER['score']} LIMIT 25 OFFSET 50) p,"
       " (SELECT count(*) AS total FROM or_lead) t")
def _(t):
    rows, total = L.feed_page(t.leads(), page=3, size=25)
    return rows.select("id", "score", total.scalar().alias("total"))


@query("F5_best_lead", f"""SELECT 'all' AS family, id, name, score FROM (SELECT * FROM or_lead ORDER BY {SQL_ORDER['score']} LIMIT 1) UNION ALL
  SELECT 'no_site', id, name, score FROM (SELECT * FROM or_lead WHERE site_state IN {O.rlist(dims.NO_SITE_STATES)} ORDER BY {SQL_ORDER['score']} LIMIT 1)
  UNION ALL SELECT 'live', id, name, score FROM (SELECT * FROM or_lead WHERE site_state IN {O.rlist(dims.SCRAPEABLE_STATES)}
    ORDER BY {SQL_ORDER['score']} LIMIT 1)""")
def _(t):
    leads = t.leads()
    return L.best_lead(leads).select(F.lit("all").alias("family"), "id", "name", "score").unionByName(L.best_by_family(leads))


def _cell(e: str) -> str:
    return f"""CASE WHEN regexp_matches({e}, '[",\\n\\r]') THEN '"' || replace({e}, '"', '""') || '"' ELSE coalesce({e}, '') END"""


_label = "CASE site_state " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.SITE_STATE_LABELS.items()) + " END"
_cells = ["name", "category_label", "score::VARCHAR", _label, "website_url", "email", "coalesce(phone_e164, phone_raw)", "followers_total::VARCHAR",
          "platforms", "city", "upper(country_code)", "pipeline_stage", "strftime(first_seen_at, '%Y-%m-%d')"]


@query("A4_leads_csv", f"""SELECT id, {" || ',' || ".join(map(_cell, _cells))} AS line FROM or_lead LEFT JOIN
  (SELECT business_id, string_agg(platform, ' ' ORDER BY platform) AS platforms FROM fx_social GROUP BY business_id) s ON s.business_id = id""")
def _(t):
    return T.csv_rows(t.leads(), t.social).select("id", "line")


# -------------------------------------------------------------- duplicates
_dup_keys = """SELECT id, {key} AS key, {name} AS name, lat, lon FROM fx_business"""
_shared = O.rlist([*dims.SOCIAL_HOSTS, *dims.LINK_HUB_HOSTS])
DUP_KEYS = {
    True: _dup_keys.format(key="lower(dedupe_key)", name="name_normalized"),
    False: _dup_keys.format(key=f"CASE WHEN contains(dedupe_key, '.') AND NOT contains(dedupe_key, ' ') AND lower(dedupe_key) NOT IN {_shared}"
                            " THEN lower(dedupe_key) END", name="nullif(name_normalized, '')"),
}


def _pairs(faithful: bool) -> str:
    return f"""SELECT a.id AS a, b.id AS b, CASE WHEN a.key = b.key THEN 'same_domain' ELSE 'same_name_nearby' END AS reason
  FROM ({DUP_KEYS[faithful]}) a JOIN ({DUP_KEYS[faithful]}) b ON a.id < b.id AND (a.key = b.key OR
  (a.name = b.name AND abs(a.lat - b.lat) < 0.0005 AND abs(a.lon - b.lon) < 0.0005))"""


def _dups(faithful: bool) -> str:
    near = f"""SELECT a.id, min(b.id) AS least FROM ({DUP_KEYS[faithful]}) a JOIN ({DUP_KEYS[faithful]}) b ON a.name = b.name
      AND abs(a.lat - b.lat) < 0.0005 AND abs(a.lon - b.lon) < 0.0005 GROUP BY a.id"""
    key = f"SELECT a.id, min(b.id) AS least FROM ({DUP_KEYS[faithful]}) a JOIN ({DUP_KEYS[faithful]}) b ON a.key = b.key GROUP BY a.id"
    both = f"SELECT a AS id, reason FROM ({_pairs(faithful)}) UNION ALL SELECT b, reason FROM ({_pairs(faithful)})"
    return f"""SELECT p.id AS business_id, reason, count(*) AS n_partners, any_value(CASE reason WHEN 'same_domain' THEN k.least ELSE n.least END) AS group_id
      FROM ({both}) p LEFT JOIN ({near}) n ON n.id = p.id LEFT JOIN ({key}) k ON k.id = p.id GROUP BY p.id, reason"""


@query("C5_possible_duplicate", _dups(False))
def _(t):
    return D.possible_duplicates(t.business)


@query("C5_possible_duplicate_faithful", _dups(True))
def _(t):
    return D.possible_duplicates(t.business, faithful=True)


@query("F4_duplicate_page", f"SELECT a AS business_a, b AS business_b, reason FROM ({_pairs(True)}) ORDER BY a, b LIMIT 200")
def _(t):
    return D.duplicate_page(t.business, faithful=True)


# ------------------------------------------------------------------- edits
def _merged(t):
    socials = t.social.select("id", "business_id", "platform", "url", "handle_normalized", "followers")
    links = t.hit.select("business_id", "query_id").distinct()
    return E.merge_leads(t.business, t.phone, t.email, socials, links, t.task, t.stage_edit, t.merge)


def _child(table: str, key: str) -> str:
    """Rows after a merge: the kept lead's own rows, then moved rows whose key it lacks."""
    return f"""SELECT * EXCLUDE (_new) FROM (SELECT x.* REPLACE (coalesce(m.keep_id, x.business_id) AS business_id), m.keep_id IS NOT NULL AS _new
      FROM {table} x LEFT JOIN fx_merge m ON m.drop_id = x.business_id)
      QUALIFY NOT _new OR row_number() OVER (PARTITION BY business_id, {key} ORDER BY _new, id) = 1"""


@query("H5_merge_leads", f"""SELECT 'lead' AS kind, id AS business_id, osm_key AS value FROM fx_business WHERE id NOT IN (SELECT drop_id FROM fx_merge)
  UNION ALL SELECT 'phone', business_id, raw FROM ({_child('fx_phone', 'coalesce(e164, raw)')})
  UNION ALL SELECT 'email', business_id, address FROM ({_child('fx_email', 'address')})
  UNION ALL SELECT 'social', business_id, url FROM ({_child('fx_social', 'platform, handle_normalized')})
  UNION ALL SELECT DISTINCT 'link', coalesce(m.keep_id, business_id), query_id::VARCHAR FROM fx_hit LEFT JOIN fx_merge m ON m.drop_id = business_id
  UNION ALL SELECT 'task', coalesce(m.keep_id, business_id), id::VARCHAR FROM fx_task LEFT JOIN fx_merge m ON m.drop_id = business_id
  UNION ALL SELECT 'event', coalesce(m.keep_id, business_id), id::VARCHAR FROM fx_stage_edit LEFT JOIN fx_merge m ON m.drop_id = business_id""")
def _(t):
    out = _merged(t)
    tall = lambda kind, df, key, value: df.select(F.lit(kind).alias("kind"), F.col(key).alias("business_id"), F.col(value).cast("string").alias("value"))
    parts = [tall("lead", out["leads"], "id", "osm_key"), tall("phone", out["phones"], "business_id", "raw"),
             tall("email", out["emails"], "business_id", "address"), tall("social", out["socials"], "business_id", "url"),
             tall("link", out["links"], "business_id", "query_id"), tall("task", out["tasks"], "business_id", "id"),
             tall("event", out["events"], "business_id", "id")]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df


@query("H6_delete_leads", """SELECT 'lead' AS kind, id, id AS business_id FROM fx_business WHERE id NOT IN (SELECT id FROM fx_delete)
  UNION ALL SELECT 'phone', id, business_id FROM fx_phone WHERE business_id NOT IN (SELECT id FROM fx_delete)
  UNION ALL SELECT 'social', id, business_id FROM fx_social WHERE business_id NOT IN (SELECT id FROM fx_delete)
  UNION ALL SELECT 'task', id, CASE WHEN business_id IN (SELECT id FROM fx_delete) THEN NULL ELSE business_id END FROM fx_task""")
def _(t):
    out = E.delete_leads(t.business, {"phone": t.phone, "social": t.social}, t.task, t.delete)
    row = lambda kind, df, key="business_id": df.select(F.lit(kind).alias("kind"), "id", F.col(key).alias("business_id"))
    return row("lead", out["leads"].withColumn("k", F.col("id")), "k").unionByName(row("phone", out["phone"])).unionByName(
        row("social", out["social"])).unionByName(row("task", out["tasks"]))


@query("H7_manual_override", """SELECT s.id, CASE WHEN o.social_id IS NULL THEN manual_override ELSE o.value END AS manual_override,
  CASE WHEN o.social_id IS NULL THEN followers_state WHEN o.value IS NULL THEN 'unknown' ELSE 'known' END AS followers_state,
  CASE WHEN o.social_id IS NULL THEN followers_reason WHEN o.value IS NULL THEN NULL ELSE 'manual' END AS followers_reason
  FROM fx_social s LEFT JOIN (SELECT * FROM fx_override WHERE value IS NULL OR value >= 0) o ON o.social_id = s.id""")
def _(t):
    return E.manual_override(t.social, t.override).select("id", "manual_override", "followers_state", "followers_reason")


_events = """SELECT e.id, e.business_id, e.at, coalesce(lag(e.to_stage) OVER (PARTITION BY e.business_id ORDER BY e.at, e.id), b.pipeline_stage)
  AS from_stage, e.to_stage FROM fx_stage_edit e JOIN fx_business b ON b.id = e.business_id"""


@query("H8_stage_change", f"SELECT id, business_id, from_stage, to_stage FROM ({_events}) WHERE from_stage <> to_stage")
def _(t):
    return E.stage_events(t.business, t.stage_edit).select("id", "business_id", "from_stage", "to_stage")


@query("H8_stage_after", """SELECT b.id, coalesce(e.s, pipeline_stage) AS pipeline_stage FROM fx_business b LEFT JOIN
  (SELECT business_id, arg_max(to_stage, row("at", id)) AS s FROM fx_stage_edit GROUP BY business_id) e ON e.business_id = b.id""")
def _(t):
    return E.stage_change(t.business, t.stage_edit).select("id", "pipeline_stage")


_patched = f"""SELECT t.*, p.id IS NOT NULL AS patched, coalesce(p.title, t.title) AS n_title, coalesce(p.note, t.note) AS n_note,
  coalesce(p.due_date, t.due_date) AS n_due, coalesce(p.status, t.status) AS n_status,
  CASE WHEN p.id IS NULL THEN t.done_at WHEN coalesce(p.status, t.status) = 'done' THEN
    CASE WHEN t.status = 'done' AND t.done_at IS NOT NULL THEN t.done_at ELSE TIMESTAMP '{NOW}' END END AS n_done,
  CASE WHEN p.id IS NULL THEN t.snooze_until ELSE p.snooze_until END AS n_snooze FROM fx_task t LEFT JOIN fx_task_patch p ON p.id = t.id"""


@query("H9_task_patch", f"""SELECT id, n_title AS title, n_note AS note, n_due::VARCHAR AS due_date, n_status AS status, epoch_us(n_done) AS done_at,
  epoch_us(n_snooze) AS snooze_until FROM ({_patched})""")
def _(t):
    df = E.task_patch(t.task, t.task_patch, NOW)["tasks"]
    return df.select("id", "title", "note", F.col("due_date").cast("string").alias("due_date"), "status", micros("done_at"), micros("snooze_until"))


@query("H9_task_patch_log", f"""SELECT CASE WHEN n_status = 'done' THEN 'task_done' ELSE 'task_undone' END AS kind, business_id, id AS task_id,
  CASE WHEN n_status = 'done' THEN n_due ELSE due_date END::VARCHAR AS day FROM ({_patched}) WHERE patched AND (status = 'done') <> (n_status = 'done')""")
def _(t):
    return E.task_patch(t.task, t.task_patch, NOW)["log"].withColumn("day", F.col("day").cast("string"))


@query("H9_task_patch_days", f"""SELECT DISTINCT d::VARCHAR AS day FROM (SELECT unnest([due_date, n_due, done_at::DATE, n_done::DATE]) AS d
  FROM ({_patched}) WHERE patched) WHERE d IS NOT NULL""")
def _(t):
    return E.task_patch(t.task, t.task_patch, NOW)["days"].select(F.col("day").cast("string").alias("day"))
