"""Dashboard numbers: totals, daily counters, streaks, task lists and run summaries."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.score import known_followers
from .folds import moving_average
from .ordered import left_join_known, numbered

STAGE_METRICS = ["contacted", "replied", "won", "lost"]
METRICS = ["tasks_created", "tasks_done", "leads_found", *STAGE_METRICS]


def day(value: str) -> Column:
    return F.lit(value).cast("date")


def js_round(col: Column) -> Column:
    """Round half up, also below zero (-12.5 becomes -12)."""
    return F.floor(col + 0.5).cast("bigint")


# ------------------------------------------------------------ lead counts
def totals(leads: DataFrame) -> DataFrame:
    state = F.col("site_state")
    return leads.agg(
        F.count("*").alias("leads"), F.count_if(state.isin(dims.NO_SITE_STATES)).alias("no_website"),
        F.count_if(state.isin(dims.DEAD_SITE_STATES)).alias("dead_site"), F.count_if(state == "social_only").alias("social_only"),
        F.count_if("has_email").alias("with_email"), F.count_if("has_phone").alias("with_phone"),
        F.count_if("has_social").alias("with_social"), F.count_if(F.col("enrichment_state") == "done").alias("enriched"))


def follower_coverage(socials: DataFrame) -> DataFrame:
    known = F.count_if(F.col("manual_override").isNotNull() | (F.col("followers_state") == "known"))
    blocked = F.count_if(F.col("followers_state").isin("blocked", "unsupported"))
    return socials.agg(known.alias("known"), blocked.alias("blocked"), F.count("*").alias("n")).select(
        "known", "blocked", F.greatest(F.lit(0), F.col("n") - F.col("known") - F.col("blocked")).alias("unknown"))


def pipeline_counts(leads: DataFrame) -> DataFrame:
    """Leads per stage, all stages present."""
    counts = leads.groupBy(F.col("pipeline_stage").alias("stage")).agg(F.count("*").alias("n"))
    stages = dims.dim(leads.sparkSession, "pipeline_stage").select("stage")
    return stages.join(counts, "stage", "left").select("stage", F.coalesce("n", F.lit(0)).alias("n"))


def funnel_progress(leads: DataFrame) -> DataFrame:
    moved = F.count_if(F.col("pipeline_stage").isin(STAGE_METRICS))
    return leads.agg(moved.alias("moved"), F.count("*").alias("leads")).select(
        "moved", "leads", F.when(F.col("leads") > 0, js_round(100 * F.col("moved") / F.col("leads"))).otherwise(0).alias("pct"))


# ----------------------------------------------------------- daily counters
def daily_stat(activity: DataFrame, tasks: DataFrame, leads: DataFrame) -> DataFrame:
    """One row per day with any activity. Each fact table is counted per day before anything is combined."""
    stage = F.get_json_object("meta", "$.toStage")
    logged = activity.groupBy("day").agg(
        F.count_if(F.col("kind") == "task_created").alias("tasks_created"),
        *(F.count_if((F.col("kind") == "stage_change") & (stage == s)).alias(s) for s in STAGE_METRICS))
    logged = logged.filter(" + ".join(["tasks_created", *STAGE_METRICS]) + " > 0")
    done = tasks.filter("done_at IS NOT NULL").groupBy(F.to_date("done_at").alias("day")).agg(F.count("*").alias("tasks_done"))
    found = leads.groupBy(F.to_date("first_seen_at").alias("day")).agg(F.count("*").alias("leads_found"))
    both = logged.unionByName(done, allowMissingColumns=True).unionByName(found, allowMissingColumns=True)
    return both.groupBy("day").agg(*(F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in METRICS))


def points(daily: DataFrame) -> DataFrame:
    worth = {"tasks_done": 5, "contacted": 15, "replied": 40, "won": 100}
    total = sum((F.coalesce(F.sum(m), F.lit(0)) * n for m, n in worth.items()), F.lit(0))
    return daily.agg(total.alias("points"))


def week_summary(daily: DataFrame, today: str) -> DataFrame:
    this = F.col("day").between(F.date_sub(day(today), 6), day(today))
    before = F.col("day").between(F.date_sub(day(today), 13), F.date_sub(day(today), 7))
    total = lambda when, m: F.coalesce(F.sum(F.when(when, F.col(m))), F.lit(0))
    sums = daily.filter(F.col("day") >= F.date_sub(day(today), 13)).agg(
        total(this, "tasks_done").alias("tasks_done"), total(this, "leads_found").alias("leads_found"), total(before, "tasks_done").alias("before"))
    change = js_round(100 * (F.col("tasks_done") - F.col("before")) / F.col("before"))
    return sums.select("tasks_done", "leads_found", "before", F.when(F.col("before") > 0, change).alias("delta_pct"))


def streak(daily: DataFrame, today: str, by: str | None = None) -> DataFrame:
    """Run of consecutive active days ending today, or yesterday when today is idle.

    Rows are days up to today, so the window groups are as long as the history in days.
    """
    keys = [by] if by else []
    recent = daily.filter(F.col("day") <= day(today))
    active = recent.filter("tasks_done > 0").select(*keys, "day").distinct()
    # the day number from the end is counted without a window when there is only one series
    island = F.date_sub("day", F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("day")).cast("int"))
    runs = active.withColumn("island", island).groupBy(*keys, "island").agg(F.max("day").alias("last"), F.count("*").alias("n"))
    runs = runs.withColumn("n", F.when(F.col("last") >= F.date_sub(day(today), 1), F.col("n")).otherwise(0))
    return runs.groupBy(*keys).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))


def dense_days(daily: DataFrame, start: str, end: str) -> DataFrame:
    """One row per day of the range, zero where nothing happened."""
    days = daily.sparkSession.range(1).select(F.explode(F.sequence(day(start), day(end))).alias("day"))
    return days.join(daily, "day", "left").select("day", *(F.coalesce(m, F.lit(0)).alias(m) for m in METRICS))


def weekday_slots(daily: DataFrame, today: str) -> DataFrame:
    """The last 7 daily rows on Monday to Sunday, with the chart scale. Days are dates, so they always parse."""
    last = daily.filter(F.col("day") <= day(today)).orderBy(F.col("day").desc()).limit(7)
    series = ["tasks_done", "leads_found", "contacted"]
    per = last.groupBy(F.weekday("day").alias("slot")).agg(
        F.min_by(F.struct(*series), "day").alias("v"), F.count("*").alias("n"))
    slots = daily.sparkSession.range(7).select(F.col("id").cast("int").alias("slot"))
    rows = slots.join(per, "slot", "left").select(
        "slot", *(F.coalesce(F.col(f"v.{m}"), F.lit(0)).alias(m) for m in series), F.col("n").isNotNull().alias("has_data"),
        (F.col("slot") == F.weekday(day(today))).alias("is_today"))
    week = Window.partitionBy(F.lit(0))  # seven rows
    return rows.withColumn("scale", F.greatest(F.lit(1), *(F.max(m).over(week) for m in series)))


# ------------------------------------------------------------------- tasks
def due_counts(tasks: DataFrame, today: str) -> DataFrame:
    is_open = F.col("status") == "open"
    return tasks.agg(F.count_if(is_open & (F.col("due_date") <= day(today))).alias("open"),
                     F.count_if(is_open & (F.col("due_date") < day(today))).alias("overdue"))


def task_business(tasks: DataFrame, leads: DataFrame) -> DataFrame:
    b = leads.select(F.col("id").alias("business_id"), F.col("name").alias("business_name"), F.col("score").alias("business_score"),
                     F.col("site_state").alias("business_site_state"))
    return left_join_known(tasks, b, "business_id")


def day_lists(tasks: DataFrame, today: str) -> DataFrame:
    """Tasks of the day view with their list: open, done, overdue or upcoming (one pass, no self union)."""
    status, due, d = F.col("status"), F.col("due_date"), day(today)
    is_open = status == "open"
    bucket = (
        F.when(is_open & (due == d), "open")
        .when((status == "done") & ((due == d) | (F.to_date("done_at") == d)), "done")
        .when(is_open & (due < d), "overdue")
        .when(is_open & (due > d) & (due <= F.date_add(d, 30)), "upcoming")
    )
    return tasks.withColumn("bucket", bucket).filter("bucket IS NOT NULL")


def day_list_order(bucket: str) -> list[Column]:
    c = F.col
    return {"open": [c("position"), c("created_at"), c("id")], "done": [c("done_at").desc(), c("id")]}.get(
        bucket, [c("due_date"), c("position"), c("id")])


def task_position(new_tasks: DataFrame, tasks: DataFrame) -> DataFrame:
    """Next positions on the due day: after the highest one there, in order of arrival."""
    top = tasks.groupBy("due_date").agg(F.max("position").alias("_top"))
    rows = numbered(new_tasks, ["due_date"], [F.col("id")], None, "_nth")
    return rows.join(top, "due_date", "left").withColumn("position", F.coalesce("_top", F.lit(0)) + F.col("_nth")).drop("_top", "_nth")


# -------------------------------------------------------- discovery and logs
def run_summary(runs: DataFrame, tiles: DataFrame) -> DataFrame:
    """Tile and POI counts of every run with its final status and note."""
    per = tiles.groupBy(F.col("query_id").alias("id")).agg(
        F.count("*").alias("tiles_total"), F.count_if(F.col("status") != "pending").alias("tiles_done"),
        F.count_if(F.col("status") == "failed").alias("tiles_failed"), F.sum("n_pois").alias("pois_found"))
    df = runs.select("id", "aborted").join(per, "id", "left").na.fill(0, ["tiles_total", "tiles_done", "tiles_failed", "pois_found"])
    status = F.when(F.col("pois_found") > 0, "done").when(F.col("aborted") | (F.col("tiles_failed") > 0), "error").otherwise("empty")
    plural = F.when(F.col("tiles_total") == 1, "").otherwise("s")
    note = F.when(F.col("aborted"), dims.RUN_ABORTED).when(
        F.col("tiles_failed") > 0, F.format_string(dims.RUN_PARTIAL, "tiles_failed", "tiles_total", plural))
    return df.select("id", "tiles_total", "tiles_done", "tiles_failed", "pois_found", status.alias("status"), note.alias("note"))


def latest_runs(runs: DataFrame, n: int = 25) -> DataFrame:
    return runs.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(n)


def latest_map_date(runs: DataFrame) -> DataFrame:
    known = runs.filter("osm_base IS NOT NULL")
    return known.agg(F.max_by("osm_base", "id").alias("osm_base"))


def discovery_enrichment(leads: DataFrame, links: DataFrame) -> DataFrame:
    """Enrichment progress of every run in one pass."""
    rows = links.select("query_id", F.col("business_id").alias("id")).join(leads.select("id", "enrichment_state", "enrichment_stage"), "id")
    state = F.col("enrichment_state")
    return rows.groupBy("query_id").agg(
        F.count_if(state == "pending").alias("queued"), F.count_if(state == "running").alias("running"),
        F.count_if(F.col("enrichment_stage") == "done").alias("done"), F.count_if(state == "failed").alias("failed"))


def since_last_success(log: DataFrame, key: str, at: list[str]) -> DataFrame:
    """Per key: successes, failures after the last success, and when and how it last failed.

    Two partially aggregated passes instead of a window over the key, so one key may hold
    any share of the log.
    """
    order = F.struct(*at)
    last = log.groupBy(key).agg(F.count_if("ok").alias("ok_count"), F.max(F.when(F.col("ok"), order)).alias("_last_ok"))
    failed = log.filter(~F.col("ok")).join(last.select(key, "_last_ok"), key)
    tail = failed.filter(F.col("_last_ok").isNull() | (order > F.col("_last_ok"))).groupBy(key).agg(
        F.count("*").alias("failures"), F.max(at[0]).alias("last_failure_at"), F.max_by("error", order).alias("last_error"))
    return last.drop("_last_ok").join(tail, key, "left").withColumn("failures", F.coalesce("failures", F.lit(0)))


def source_health(log: DataFrame) -> DataFrame:
    """Successes, current failures, average latency, last element count and cooldown of every source."""
    at = ["ts", "id"]
    base = since_last_success(log, "source", at)
    last = log.filter("ok").groupBy("source").agg(F.max_by("n_elements", F.struct(*at)).alias("last_n_elements"))
    avg = moving_average(log.filter("ok"), "source", at)
    df = base.join(last, "source", "left").join(avg, "source", "left")
    return df.withColumn("cooldown_min", F.when(F.col("failures") > 0, F.least(F.lit(30), 5 * F.col("failures"))).otherwise(0))


def source_rank(health: DataFrame, now: str) -> DataFrame:
    """Order in which to ask the sources: healthy ones only, unless none is.

    One row per source, a list of configured servers, so ranking them in one task is bounded.
    """
    until = F.col("last_failure_at") + F.make_interval(mins=F.col("cooldown_min").cast("int"))
    healthy = (F.col("failures") == 0) | (until < F.lit(now).cast("timestamp"))
    df = health.withColumn("healthy", F.coalesce(healthy, F.lit(True)))
    df = df.withColumn("any_healthy", F.bool_or("healthy").over(Window.partitionBy(F.lit(0))))
    pool = df.filter(F.col("healthy") | ~F.col("any_healthy")).drop("any_healthy")
    order = Window.partitionBy(F.lit(0)).orderBy("failures", F.col("ok_count").desc(), F.coalesce("avg_ms", F.lit(20000)), "source")
    return pool.withColumn("rank", F.row_number().over(order))


def domain_health(log: DataFrame, now: str) -> DataFrame:
    """A domain with five failures since its last success rests for 30 minutes after the last one."""
    df = since_last_success(log, "domain", ["ts", "id"])
    until = F.when(F.col("failures") >= 5, F.col("last_failure_at") + F.expr("INTERVAL 30 MINUTES"))
    return df.withColumn("unhealthy", F.coalesce(until > F.lit(now).cast("timestamp"), F.lit(False)))


def latest_progress(events: DataFrame, logs: int = 8) -> DataFrame:
    """The newest frame of every kind that keeps only one, and the newest log lines."""
    order = F.struct("at", "id")
    newest = events.filter(F.col("type").isin("discovery", "queue")).groupBy("type").agg(F.max_by(F.struct("id", "at"), order).alias("e"))
    lines = events.filter("type = 'log'").orderBy(F.col("at").desc(), F.col("id").desc()).limit(logs)
    return newest.select("type", "e.id").unionByName(lines.select("type", "id"))


def parse_events(frames: DataFrame) -> DataFrame:
    """JSON progress frames as typed rows; unknown kinds and frames without their id are dropped."""
    json = F.from_json("value", "type string, at bigint, queryId bigint, businessId bigint, status string, poisFound bigint,"
                       " tilesDone bigint, tilesTotal bigint, mirror string, pending bigint, inFlight bigint, stage string,"
                       " state string, score bigint, level string, message string")
    e = frames.withColumn("e", json)
    kind, zero = F.col("e.type"), F.lit(0)
    usable = (
        kind.isin("hello", "ping", "queue", "log") | ((kind == "discovery") & F.col("e.queryId").isNotNull())
        | ((kind == "lead") & F.col("e.businessId").isNotNull())
    )
    only = lambda k, c: F.when(kind == k, c)
    return e.filter(usable).select(
        *frames.columns, kind.alias("type"), F.col("e.queryId").alias("query_id"), F.col("e.businessId").alias("business_id"),
        F.coalesce(only("discovery", F.coalesce("e.status", F.lit("unknown")))).alias("status"),
        only("discovery", F.coalesce("e.poisFound", zero)).alias("pois_found"),
        only("discovery", F.coalesce("e.tilesDone", zero)).alias("tiles_done"),
        only("discovery", F.coalesce("e.tilesTotal", zero)).alias("tiles_total"), only("discovery", F.col("e.mirror")).alias("mirror"),
        only("queue", F.coalesce("e.pending", zero)).alias("pending"), only("queue", F.coalesce("e.inFlight", zero)).alias("in_flight"),
        only("lead", F.coalesce("e.stage", F.lit("unknown"))).alias("stage"), only("lead", F.coalesce("e.state", F.lit("unknown"))).alias("state"),
        only("lead", F.col("e.score")).alias("score"),
        only("log", F.when(F.col("e.level").isin("info", "warn", "error"), F.col("e.level")).otherwise("info")).alias("level"),
        only("log", F.coalesce("e.message", F.lit(""))).alias("message"))
