"""Structured Streaming jobs, run to the end of the given events and read back."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.snapshot import Snapshot
from ..session import shared_dir
from ..streaming import jobs as J
from .fixtures import FIXTURES
from .registry import query

#: How long a work key is closed in the registered query.
KEY_SECONDS = 86_400


def event_stream(t, fixture: str):
    """A fixture over the events as a stream instead of a table."""
    schema = t.events.schema
    raw = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    view = "events_" + uuid.uuid4().hex
    raw.createOrReplaceTempView(view)
    return t.spark.sql(FIXTURES[fixture].format(events=view))


def folders(t, name: str) -> tuple[str, str]:
    base = f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


@query("M1_stream_daily", "SELECT day::VARCHAR AS day, tasks_created, contacted, replied, won, lost FROM or_daily WHERE tasks_created + contacted + replied + won + lost > 0")
def _(t):
    out, checkpoint = folders(t, "daily")
    counters = J.DailyCounters(t.spark, out)
    activity = event_stream(t, "fx_activity").withColumn("at", F.col("at").cast("timestamp"))
    J.stream_daily(activity, counters, checkpoint).awaitTermination()
    return counters.read().withColumn("day", F.col("day").cast("string"))


@query("M2_stream_dedupe", f"""SELECT key, unnest(list_transform(list_reduce(list([us] ORDER BY us), lambda a, x: CASE WHEN x[1] >= a[len(a)] + {KEY_SECONDS * 1_000_000} THEN list_concat(a, x) ELSE a END), lambda u: u)) AS at
  FROM (SELECT 'probe:' || business_id AS key, epoch_us("at") AS us FROM fx_activity) GROUP BY key""")
def _(t):
    out, checkpoint = folders(t, "dedupe")
    keyed = event_stream(t, "fx_activity").select(F.concat(F.lit("probe:"), F.col("business_id").cast("string")).alias("key"), "at")
    J.start(J.stream_dedupe(keyed, "key", "at", KEY_SECONDS), checkpoint, J.batch_folders(out), "append").awaitTermination()
    return t.spark.read.parquet(out).select("key", F.unix_micros("at").alias("at"))


@query("M3_stream_rescore", "SELECT id, score, confidence_pct::BIGINT AS confidence_pct, tier, has_phone, has_email, has_social FROM or_lead WHERE id IN (SELECT business_id FROM fx_activity)")
def _(t):
    out, checkpoint = folders(t, "rescore")
    tables = J.keyed_tables(t.spark, {"leads": t.business, "phones": t.phone, "emails": t.email, "socials": t.social}, out + "/tables", 8)
    target = Snapshot(t.spark, out + "/scores", "id", J.SCORES, 8)
    J.stream_rescore(event_stream(t, "fx_activity"), tables, target, checkpoint).awaitTermination()
    return target.read()


@query("M4_stream_progress", """SELECT type, arg_max(id, row("at", id)) AS id, count(*) AS n FROM (SELECT id, "at", json_extract_string(v, '$.type') AS type, v FROM (
  SELECT id, "at", CASE WHEN json_valid(value) THEN value END AS v FROM fx_progress)) WHERE type IN ('hello', 'ping', 'queue', 'log', 'discovery', 'lead')
  AND NOT (type = 'lead' AND json_extract_string(v, '$.businessId') IS NULL) GROUP BY type""")
def _(t):
    out, checkpoint = folders(t, "progress")
    target = Snapshot(t.spark, out, "type", J.PROGRESS, 1)
    J.stream_progress(event_stream(t, "fx_progress"), target, checkpoint).awaitTermination()
    return target.read().select("type", "id", "n")
