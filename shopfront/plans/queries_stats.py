"""Dashboard numbers, task lists and progress."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..functions import urls as U
from ..operators import cubes as CU
from ..operators import stats as S
from ..operators import temporal as TJ
from ..operators.ordered import left_join_known
from . import oracle_tables as O
from .fixtures import TODAY
from .registry import query

D = f"DATE '{TODAY}'"
text_day = lambda df: df.withColumn("day", F.col("day").cast("string"))


def daily(t):
    return S.daily_stat(t.activity, t.task, t.business)


@query("C2_task_business", "SELECT t.id, t.business_id, b.name AS business_name, b.score AS business_score, b.site_state AS business_site_state FROM fx_task t LEFT JOIN or_lead b ON b.id = t.business_id")
def _(t):
    return S.task_business(t.task, t.leads()).select("id", "business_id", "business_name", "business_score", "business_site_state")


@query("D3_totals", f"""SELECT count(*) AS leads, count(*) FILTER (WHERE site_state IN {O.rlist(dims.NO_SITE_STATES)}) AS no_website,
  count(*) FILTER (WHERE site_state IN ('dead', 'parked', 'server_down')) AS dead_site, count(*) FILTER (WHERE site_state = 'social_only') AS social_only,
  count(*) FILTER (WHERE has_email) AS with_email, count(*) FILTER (WHERE has_phone) AS with_phone, count(*) FILTER (WHERE has_social) AS with_social,
  count(*) FILTER (WHERE enrichment_state = 'done') AS enriched FROM or_denorm""")
def _(t):
    return S.totals(t.denorm())


@query("D4_follower_coverage", """SELECT known, blocked, greatest(0, n - known - blocked) AS unknown FROM (SELECT count(*) AS n,
  count(*) FILTER (WHERE manual_override IS NOT NULL OR followers_state = 'known') AS known, count(*) FILTER (WHERE followers_state IN ('blocked', 'unsupported')) AS blocked FROM fx_social)""")
def _(t):
    return S.follower_coverage(t.social)


@query("D5_pipeline_counts", "SELECT s.stage, count(b.id) AS n FROM (VALUES ('new'), ('contacted'), ('replied'), ('won'), ('lost')) s(stage) LEFT JOIN fx_business b ON b.pipeline_stage = s.stage GROUP BY s.stage")
def _(t):
    return S.pipeline_counts(t.business)


@query("D6_daily_stat", "SELECT * REPLACE (day::VARCHAR AS day) FROM or_daily")
def _(t):
    return text_day(daily(t))


@query("D7_points", "SELECT (5 * sum(tasks_done) + 15 * sum(contacted) + 40 * sum(replied) + 100 * sum(won))::BIGINT AS points FROM or_daily")
def _(t):
    return S.points(daily(t))


@query("D8_week_summary", f"""SELECT tasks_done, leads_found, before, CASE WHEN before > 0 THEN floor(100.0 * (tasks_done - before) / before + 0.5)::BIGINT END AS delta_pct FROM (SELECT
  coalesce(sum(tasks_done) FILTER (WHERE day BETWEEN {D} - 6 AND {D}), 0)::BIGINT AS tasks_done, coalesce(sum(leads_found) FILTER (WHERE day BETWEEN {D} - 6 AND {D}), 0)::BIGINT AS leads_found,
  coalesce(sum(tasks_done) FILTER (WHERE day BETWEEN {D} - 13 AND {D} - 7), 0)::BIGINT AS before FROM or_daily)""")
def _(t):
    return S.week_summary(daily(t), TODAY)


@query("D9_due_counts", f"""SELECT count(*) FILTER (WHERE status = 'open' AND due_date <= {D}) AS open, count(*) FILTER (WHERE status = 'open' AND due_date < {D}) AS overdue FROM fx_task""")
def _(t):
    return S.due_counts(t.task, TODAY)


@query("D14_funnel_progress", """SELECT count(*) FILTER (WHERE pipeline_stage <> 'new') AS moved, count(*) AS leads,
  floor(100.0 * count(*) FILTER (WHERE pipeline_stage <> 'new') / count(*) + 0.5)::BIGINT AS pct FROM fx_business""")
def _(t):
    return S.funnel_progress(t.business)


@query("D16_weekday_slots", f"""WITH l AS (SELECT * FROM or_daily WHERE day <= {D} ORDER BY day DESC LIMIT 7),
  s AS (SELECT s.slot, coalesce(arg_min(tasks_done, day), 0) AS tasks_done, coalesce(arg_min(leads_found, day), 0) AS leads_found, coalesce(arg_min(contacted, day), 0) AS contacted,
    count(day) > 0 AS has_data, s.slot = isodow({D}) - 1 AS is_today FROM range(7) s(slot) LEFT JOIN l ON isodow(l.day) - 1 = s.slot GROUP BY s.slot)
  SELECT *, (SELECT greatest(1, max(tasks_done), max(leads_found), max(contacted)) FROM s) AS scale FROM s""")
def _(t):
    return S.weekday_slots(daily(t), TODAY)


def _streak(keys: str, src: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    sel = f"{keys}, " if keys else ""
    return f"""SELECT {sel}max(CASE WHEN last >= {D} - 1 THEN n ELSE 0 END)::BIGINT AS n FROM (SELECT {sel}max(day) AS last, count(*) AS n FROM (
      SELECT *, day - (row_number() OVER ({part} ORDER BY day))::INT AS island FROM (SELECT DISTINCT {sel}day FROM {src} WHERE tasks_done > 0 AND day <= {D}))
      GROUP BY {sel}island) GROUP BY ALL"""


@query("E3_streak", _streak("", "or_daily"))
def _(t):
    return S.streak(daily(t), TODAY)


@query("E3_streak_by_user", _streak("business_id", "(SELECT business_id, done_at::DATE AS day, count(*) AS tasks_done FROM fx_task WHERE done_at IS NOT NULL AND business_id IS NOT NULL GROUP BY ALL)"))
def _(t):
    per = t.task.filter("done_at IS NOT NULL AND business_id IS NOT NULL").groupBy("business_id", F.to_date("done_at").alias("day")).agg(F.count("*").alias("tasks_done"))
    return S.streak(per, TODAY, by="business_id")


@query("E4_dense_days", f"""SELECT d::DATE::VARCHAR AS day, {', '.join(f'coalesce({m}, 0) AS {m}' for m in S.METRICS)}
  FROM generate_series(DATE '2023-12-20', DATE '2024-02-10', INTERVAL 1 DAY) g(d) LEFT JOIN or_daily o ON o.day = d::DATE""")
def _(t):
    return text_day(S.dense_days(daily(t), "2023-12-20", "2024-02-10"))


@query("E7_task_position", """SELECT id, coalesce((SELECT max(position) FROM fx_task x WHERE x.due_date = n.due_date AND x.id % 2 = 0), 0) + row_number() OVER (PARTITION BY due_date ORDER BY id) AS position
  FROM fx_task n WHERE id % 2 = 1""")
def _(t):
    arriving, known = t.task.filter("id % 2 = 1").drop("position"), t.task.filter("id % 2 = 0")
    return S.task_position(arriving, known).select("id", "position")


@query("F3_day_lists", f"""SELECT id, CASE WHEN status = 'open' AND due_date = {D} THEN 'open' WHEN status = 'done' AND (due_date = {D} OR done_at::DATE = {D}) THEN 'done'
  WHEN status = 'open' AND due_date < {D} THEN 'overdue' WHEN status = 'open' AND due_date > {D} AND due_date <= {D} + 30 THEN 'upcoming' END AS bucket
  FROM fx_task WHERE bucket IS NOT NULL""")
def _(t):
    return S.day_lists(t.task, TODAY).select("id", "bucket")


_frame = """SELECT id, "at", json_extract_string(value, '$.type') AS type, (value::JSON->>'queryId')::BIGINT AS query_id, (value::JSON->>'businessId')::BIGINT AS business_id,
  value::JSON AS j FROM (SELECT * REPLACE (CASE WHEN json_valid(value) THEN value END AS value) FROM fx_progress) WHERE json_extract_string(value, '$.type') IN ('hello', 'ping', 'queue', 'log', 'discovery', 'lead')
  AND NOT (json_extract_string(value, '$.type') = 'lead' AND json_extract_string(value, '$.businessId') IS NULL)"""


@query("B17_lenient_event_parse", f"""SELECT id, type, query_id, business_id, CASE WHEN type = 'discovery' THEN coalesce(j->>'status', 'unknown') END AS status,
  CASE WHEN type = 'discovery' THEN coalesce((j->>'poisFound')::BIGINT, 0) END AS pois_found, CASE WHEN type = 'queue' THEN (j->>'pending')::BIGINT END AS pending,
  CASE WHEN type = 'queue' THEN 0 END AS in_flight, CASE WHEN type = 'lead' THEN 'unknown' END AS state,
  CASE WHEN type = 'log' THEN CASE WHEN j->>'level' IN ('info', 'warn', 'error') THEN j->>'level' ELSE 'info' END END AS level, CASE WHEN type = 'log' THEN j->>'message' END AS message
  FROM ({_frame})""")
def _(t):
    return S.parse_events(t.progress).select("id", "type", "query_id", "business_id", "status", "pois_found", "pending", "in_flight", "state", "level", "message")


@query("E12_latest_progress", f"""SELECT type, id FROM (SELECT type, arg_max(id, row("at", id)) AS id FROM ({_frame}) WHERE type IN ('discovery', 'queue') GROUP BY type) UNION ALL
  (SELECT type, id FROM ({_frame}) WHERE type = 'log' ORDER BY "at" DESC, id DESC LIMIT 8)""")
def _(t):
    return S.latest_progress(S.parse_events(t.progress))


@query("J6_local_day", """SELECT event_id AS id, ts::DATE::VARCHAR AS day, (ts::DATE - 6)::VARCHAR AS week_start, (ts::DATE + 30)::VARCHAR AS until FROM events""")
def _(t):
    day = U.local_day(F.col("ts"))
    return t.events.select(F.col("event_id").alias("id"), day.cast("string").alias("day"), F.date_add(day, -6).cast("string").alias("week_start"),
                           F.date_add(day, 30).cast("string").alias("until"))


# ------------------------------------------------------------ joins in time
@query("X3_stage_held", """SELECT a.id, e.to_stage AS stage FROM fx_activity a ASOF LEFT JOIN (SELECT business_id, "at", arg_max(to_stage, id) AS to_stage FROM fx_stage_edit GROUP BY ALL) e
  ON a.business_id = e.business_id AND e."at" <= a."at" """)
def _(t):
    return TJ.asof_join(t.activity, t.stage_edit, ["business_id"], "at", "at", ["to_stage"], "id").select("id", F.col("to_stage").alias("stage"))


@query("X4_activity_during_tasks", """SELECT t.id, count(a.id) AS n FROM fx_task t LEFT JOIN fx_activity a ON a.business_id = t.business_id AND a."at" >= t.created_at AND (t.done_at IS NULL OR a."at" < t.done_at) GROUP BY t.id""")
def _(t):
    return TJ.count_during(t.task, t.activity, ["business_id"], "id", "created_at", "done_at", "at")


@query("X4_activity_of_waiting_tasks", """SELECT t.id AS task_id, a.id AS activity_id FROM fx_task t JOIN fx_activity a ON a.business_id = t.business_id AND a."at" >= t.created_at AND a."at" < t.created_at + INTERVAL 5 DAY
  WHERE t.status IN ('open', 'snoozed')""")
def _(t):
    waiting = t.task.filter(F.col("status").isin("open", "snoozed")).select(
        F.col("id").alias("task_id"), "business_id", "created_at", (F.col("created_at") + F.expr("INTERVAL 5 DAYS")).alias("until"))
    met = TJ.during(waiting, t.activity.select(F.col("id").alias("activity_id"), "business_id", "at"), ["business_id"], "created_at", "until", "at")
    return met.select("task_id", "activity_id")


_act = "(SELECT a.business_id, a.day, date_trunc('week', a.day)::DATE AS week, date_trunc('month', a.day)::DATE AS month, b.category FROM fx_activity a LEFT JOIN fx_business b ON b.id = a.business_id)"
_levels = " UNION ALL ".join(
    f"SELECT '{name}' AS level, {', '.join((c if c in cs else 'NULL') + '::VARCHAR AS ' + c for c in ('day', 'week', 'month', 'category'))}, count(*) AS n, count(DISTINCT business_id) AS exact, true AS within"
    f" FROM {_act}" + (f" GROUP BY {', '.join(cs)}" if cs else "") for name, cs in CU.LEVELS.items())


@query("X5_activity_cube", _levels)
def _(t):
    activity = left_join_known(t.activity.select("business_id", "day"), t.business.select(F.col("id").alias("business_id"), "category"), "business_id")
    cube = CU.activity_cube(activity)
    # four standard errors; small sets are counted all but exactly
    within = F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(F.lit(1.0), 4 * CU.ERROR * F.col("exact"))
    return cube.select("level", *(F.col(c).cast("string").alias(c) for c in ("day", "week", "month", "category")), "n", "exact", within.alias("within"))
