"""Structured Streaming jobs over append-only parquet folders.

Every micro-batch is merged into a snapshot cut by the hash of its key: only the folders that the batch's keys fall into are read and
rewritten, so what a reader opens does not grow with the batches. Merging a batch twice gives the same rows: sums carry the number of
the last batch they hold, all else is replaced by key. A target belongs to one checkpoint.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import leads as L
from ..operators import stats as S
from ..operators.snapshot import Snapshot

COUNTERS = ["tasks_created", *S.STAGE_METRICS]


def start(df: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "update") -> StreamingQuery:
    """Runs a stream over all data available now; `write` takes each micro-batch with its number and may be called again with it."""
    return df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_folders(path: str) -> Callable[[DataFrame, int], None]:
    """A writer of one folder per micro-batch, overwritten on replay."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def replace_keys(target: Snapshot, fresh: DataFrame) -> None:
    """Rows of the keys in `fresh` take the place of those in the target."""
    folders = target.touched(fresh)
    if folders:
        others = target.read(folders).join(fresh.select(target.key), target.key, "left_anti")
        target.replace(others.unionByName(fresh.select(*others.columns)))


# ------------------------------------------------------------------ counters
class DailyCounters:
    """Where the daily counters of a stream are kept: days, rows that came late, and how far the event time has got."""

    def __init__(self, spark: SparkSession, path: str, folders: int = 16):
        counts = ", ".join(f"{c} bigint" for c in COUNTERS)
        self.spark, self.path = spark, path.rstrip("/")
        self.days = Snapshot(spark, f"{self.path}/days", "day", f"day date, {counts}, batch bigint", folders)

    def read(self) -> DataFrame:
        return self.days.read().drop("batch")

    def late(self) -> DataFrame:
        """Rows that came behind the watermark, with the batch they came in; their days hold them."""
        return self.spark.read.parquet(f"{self.path}/late")

    def latest(self, batch: int) -> object:
        """The greatest event time before a batch."""
        if batch == 0:
            return None
        return self.spark.read.schema("at timestamp").parquet(f"{self.path}/clock/batch={batch - 1}").first()[0]


def day_counts(activity: DataFrame) -> DataFrame:
    stage = F.get_json_object("meta", "$.toStage")
    return activity.groupBy(F.to_date("at").alias("day")).agg(
        F.count_if(F.col("kind") == "task_created").alias("tasks_created"),
        *(F.count_if((F.col("kind") == "stage_change") & (stage == s)).alias(s) for s in S.STAGE_METRICS))


def stream_daily(activity: DataFrame, counters: DailyCounters, checkpoint: str, delay: str = "2 days") -> StreamingQuery:
    """Counters of the activity log per event-time day. Every row reaches its day, however late.

    A micro-batch is counted by day and the counts are added to the days it touches. Rows more than `delay` behind the greatest event time of
    the batches before also go to the late table, so that whoever has closed a day learns that it has changed. The stream holds no state.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.filter("at IS NOT NULL").persist()
        seen = counters.latest(number)
        watermark = F.lit(seen).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        late = batch.filter(F.col("at") < watermark) if seen is not None else batch.filter("false")
        late.write.mode("overwrite").parquet(f"{counters.path}/late/batch={number}")
        fresh = day_counts(batch)
        folders = counters.days.touched(fresh)
        if folders:
            old = counters.days.read(folders)
            more = fresh.select("day", *(F.col(c).alias("new_" + c) for c in COUNTERS))
            # a day that holds this batch already, or a later one, is being written again
            due = F.coalesce(F.col("batch") < number, F.lit(True)) & F.col("new_tasks_created").isNotNull()
            zero = F.lit(0)
            added = {c: F.coalesce(c, zero) + F.when(due, F.coalesce("new_" + c, zero)).otherwise(zero) for c in COUNTERS}
            merged = old.join(more, "day", "full_outer").select(
                "day", *(v.alias(c) for c, v in added.items()), F.when(due, F.lit(number)).otherwise(F.col("batch")).cast("bigint").alias("batch"))
            counters.days.replace(merged)
        clock = batch.agg(F.max("at").alias("at")).select(F.greatest("at", F.lit(seen).cast("timestamp")).alias("at"))
        clock.coalesce(1).write.mode("overwrite").parquet(f"{counters.path}/clock/batch={number}")
        batch.unpersist()

    return start(activity, checkpoint, write, "append")


# ------------------------------------------------------------------ work keys
def accept(ttl_seconds: int):
    """For applyInPandasWithState: the rows of a key that come at least `ttl` after the last one that was let through."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts), ignore_index=True)
        until = state.get[0] if state.exists else None
        times = sorted(int(t.value // 1000) for t in rows["at"])  # microseconds
        let = []
        for t in times:
            if until is None or t >= until:
                let.append(t)
                until = t + ttl_seconds * 1_000_000
        state.update((until,))
        # the key is forgotten when the watermark has passed its time
        state.setTimeoutTimestamp(max(until // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]] * len(let), "at": pd.to_datetime(pd.Series(let, dtype="int64"), unit="us")})

    return run


def stream_dedupe(stream: DataFrame, key: str, at: str, ttl_seconds: int, delay: str = "1 day") -> DataFrame:
    """(key, at) of the work that is let through: a key is taken, then closed for `ttl_seconds` of event time, then free again.

    State is one number per key whose time is not over; when the watermark has passed it, the key is forgotten. The rows of one
    key in a micro-batch are a handful of times in memory. Rows behind the watermark and rows without a key or time are dropped.
    """
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at")).filter("key IS NOT NULL AND at IS NOT NULL")
    # equal rows of a batch say nothing more
    return rows.withWatermark("at", delay).groupBy("key").applyInPandasWithState(
        accept(ttl_seconds), "key string, at timestamp", "until bigint", "append", GroupStateTimeout.EventTimeTimeout)


# ------------------------------------------------------------------ scores
SCORES = "id bigint, score bigint, confidence_pct int, tier string, has_phone boolean, has_email boolean, has_social boolean"


def keyed_tables(spark: SparkSession, tables: dict[str, DataFrame], path: str, folders: int = 64) -> dict[str, Snapshot]:
    """Leads by id and their contacts by business_id as snapshots cut alike."""
    out = {}
    for name, df in tables.items():
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        out[name] = Snapshot(spark, f"{path}/{name}", "id" if name == "leads" else "business_id", schema, folders)
        out[name].replace(df)
    return out


def stream_rescore(results: DataFrame, tables: dict[str, Snapshot], target: Snapshot, checkpoint: str, preset: str = "websites") -> StreamingQuery:
    """Each batch of enrichment results (business_id) refreshes and rescores the leads it touches and puts them in their place.

    tables: leads, phones, emails and socials as `keyed_tables` cuts them, into as many folders as the target: of each only the touched folders are read.
    """

    def write(batch: DataFrame, number: int) -> None:
        ids = batch.select("business_id").filter("business_id IS NOT NULL").distinct().persist()
        folders = tables["leads"].touched(ids, "business_id")
        part = lambda name, key: tables[name].read(folders).join(ids.withColumnRenamed("business_id", key), key, "left_semi")
        fresh = L.denorm(part("leads", "id"), *(part(n, "business_id") for n in ("phones", "emails", "socials")))
        scored = L.scored(fresh, preset).select("id", "score", "confidence_pct", "tier", "has_phone", "has_email", "has_social")
        replace_keys(target, scored)
        ids.unpersist()

    return start(results, checkpoint, write, "append")


# ------------------------------------------------------------------ progress
def stream_progress(frames: DataFrame, target: Snapshot, checkpoint: str) -> StreamingQuery:
    """Newest progress frame of every kind and how many there were; state and target have one row per kind."""
    events = S.parse_events(frames)
    newest = events.groupBy("type").agg(F.max(F.struct("at", "id")).alias("last"), F.count("*").alias("n"))
    rows = newest.select("type", F.col("last.id").alias("id"), F.col("last.at").alias("at"), "n")
    return start(rows, checkpoint, lambda batch, number: replace_keys(target, batch))


PROGRESS = "type string, id bigint, at timestamp, n bigint"
