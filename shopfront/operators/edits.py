"""Edits to leads, contacts and tasks: old tables plus a table of changes give new tables."""
from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .leads import denorm, scored
from .ordered import previous
from .workspace import Workspace


def final_targets(pairs: DataFrame) -> DataFrame:
    """(drop_id, keep_id) with one row per dropped lead, its target being a lead that stays.

    A lead dropped twice goes to the smaller of its targets. Chains are followed by doubling, so a chain of n
    merges takes about log2(n) rounds; leads that are merged in a circle have no target and raise an error.
    """
    ws = Workspace(pairs.sparkSession, "merge-targets")
    written = lambda df: ws.written(df, uuid.uuid4().hex)
    moves = written(pairs.filter("drop_id <> keep_id").groupBy("drop_id").agg(F.min("keep_id").alias("keep_id")))
    for _ in range(moves.count().bit_length() + 1):
        onward = moves.select(F.col("drop_id").alias("keep_id"), F.col("keep_id").alias("_next"))
        joined = moves.join(onward, "keep_id", "left")
        if joined.filter("_next IS NOT NULL").isEmpty():
            return moves
        moves = written(joined.select("drop_id", F.coalesce("_next", "keep_id").alias("keep_id")))
    raise ValueError("leads are merged in a circle")


def merge_leads(leads: DataFrame, phones: DataFrame, emails: DataFrame, socials: DataFrame, links: DataFrame, tasks: DataFrame,
                events: DataFrame, pairs: DataFrame) -> dict[str, DataFrame]:
    """Applies (keep_id, drop_id) pairs to all tables of a lead.

    Contacts the kept lead lacks are copied over, tasks and pipeline events re-pointed, the dropped lead
    and its own contacts removed. `rescored` then refreshes counts and scores.
    A lead may be dropped twice or kept by one pair and dropped by another; see final_targets.
    """
    moves = final_targets(pairs).select(F.col("drop_id").alias("business_id"), "keep_id")

    def children(df: DataFrame, key: list[str]) -> DataFrame:
        """One pass: each row under the lead it goes to; a moved row stays if it is the first of its key there and no own row has that key."""
        order = [F.col("id")] if "id" in df.columns else [F.col(c) for c in df.columns if c not in key]
        rows = df.join(moves, "business_id", "left").withColumns({"_moved": F.col("keep_id").isNotNull(), "business_id": F.coalesce("keep_id", "business_id")})
        of_key = Window.partitionBy("business_id", *key)
        given = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in key))
        rows = rows.withColumns({"_own": F.max(~F.col("_moved")).over(of_key) & given, "_nth": F.row_number().over(Window.partitionBy("business_id", *key, "_moved").orderBy(*order))})
        return rows.filter(~F.col("_moved") | (~F.col("_own") & (F.col("_nth") == 1))).select(*df.columns)

    def repoint(df: DataFrame) -> DataFrame:
        return df.join(moves, "business_id", "left").withColumn("business_id", F.coalesce("keep_id", "business_id")).select(*df.columns)

    with_key = phones.withColumn("phone_key", F.coalesce("e164", "raw"))
    return {
        "leads": leads.join(moves.withColumnRenamed("business_id", "id"), "id", "left_anti"),
        "phones": children(with_key, ["phone_key"]).drop("phone_key"),
        "emails": children(emails, ["address"]),
        "socials": children(socials, ["platform", "handle_normalized"]),
        "links": children(links, ["query_id"]),
        "tasks": repoint(tasks),
        "events": repoint(events),
    }


def rescored(merged: dict[str, DataFrame]) -> DataFrame:
    """The leads of a merge with their counts, flags and scores taken anew from the merged contacts."""
    return scored(denorm(*(merged[name] for name in ("leads", "phones", "emails", "socials"))))


def delete_leads(leads: DataFrame, children: dict[str, DataFrame], tasks: DataFrame, ids: DataFrame) -> dict[str, DataFrame]:
    """Removes leads; their child rows go with them, their tasks stay without a lead."""
    gone = ids.select(F.col("id").alias("business_id")).withColumn("_gone", F.lit(True))
    kept = {name: df.join(gone, "business_id", "left_anti") for name, df in children.items()}
    loose = tasks.join(gone, "business_id", "left").withColumn(
        "business_id", F.when(F.col("_gone").isNull(), F.col("business_id"))).select(*tasks.columns)
    return {"leads": leads.join(ids, "id", "left_anti"), **kept, "tasks": loose}


def manual_override(socials: DataFrame, edits: DataFrame) -> DataFrame:
    """Follower numbers typed in by hand (social_id, value). NULL clears; a negative value is refused."""
    valid = edits.filter("value IS NULL OR value >= 0").select(F.col("social_id").alias("id"), F.col("value"), F.lit(True).alias("_edit"))
    df = socials.join(valid, "id", "left")
    edited, cleared = F.col("_edit").isNotNull(), F.col("value").isNull()
    return df.withColumns({
        "manual_override": F.when(edited, F.col("value")).otherwise(F.col("manual_override")),
        "followers_state": F.when(edited, F.when(cleared, "unknown").otherwise("known")).otherwise(F.col("followers_state")),
        "followers_reason": F.when(edited, F.when(~cleared, "manual")).otherwise(F.col("followers_reason")),
    }).select(*socials.columns)


def stage_events(leads: DataFrame, edits: DataFrame) -> DataFrame:
    """Pipeline events of ordered stage edits; an edit to the stage already held emits nothing."""
    before = previous(edits, ["business_id"], [F.col("at"), F.col("id")], "to_stage", None, "_before")
    current = leads.select(F.col("id").alias("business_id"), "pipeline_stage")
    rows = before.join(current, "business_id").withColumn("from_stage", F.coalesce("_before", "pipeline_stage"))
    return rows.filter("from_stage <> to_stage").select("id", "business_id", "at", "from_stage", "to_stage")


def stage_log(events: DataFrame) -> DataFrame:
    """Activity-log rows of pipeline events, as the daily counters read them."""
    meta = F.to_json(F.struct(F.col("from_stage").alias("fromStage"), F.col("to_stage").alias("toStage")))
    return events.select("id", F.lit("stage_change").alias("kind"), "business_id", "at", F.to_date("at").alias("day"), meta.alias("meta"))


def stage_change(leads: DataFrame, edits: DataFrame) -> DataFrame:
    """Leads with the stage of their last edit."""
    last = edits.groupBy(F.col("business_id").alias("id")).agg(F.max_by("to_stage", F.struct("at", "id")).alias("_stage"))
    return leads.join(last, "id", "left").withColumn("pipeline_stage", F.coalesce("_stage", "pipeline_stage")).drop("_stage")


def patched(tasks: DataFrame, patches: DataFrame, now: str) -> DataFrame:
    """Tasks joined to their patch, with both states side by side (old columns prefixed `was_`)."""
    p = patches.select("id", *(F.col(c).alias(f"p_{c}") for c in ("title", "note", "due_date", "status", "snooze_until")), F.lit(True).alias("_patched"))
    df = tasks.withColumns({f"was_{c}": F.col(c) for c in ("status", "due_date", "done_at")}).join(p, "id", "left")
    hit = F.col("_patched").isNotNull()
    status = F.coalesce("p_status", "status")
    done_at = F.when(status == "done", F.when((F.col("was_status") == "done") & F.col("was_done_at").isNotNull(), F.col("was_done_at"))
                     .otherwise(F.lit(now).cast("timestamp")))
    return df.withColumns({
        "title": F.coalesce("p_title", "title"), "note": F.coalesce("p_note", "note"), "due_date": F.coalesce("p_due_date", "due_date"),
        "status": status, "done_at": F.when(hit, done_at).otherwise(F.col("was_done_at")),
        "snooze_until": F.when(hit, F.col("p_snooze_until")).otherwise(F.col("snooze_until")), "patched": hit,
    }).drop("p_title", "p_note", "p_due_date", "p_status", "p_snooze_until", "_patched")


def task_patch(tasks: DataFrame, patches: DataFrame, now: str) -> dict[str, DataFrame]:
    """New task table, log rows of finished and reopened tasks, and the days whose counters change."""
    df = patched(tasks, patches, now)
    was_done, is_done = F.col("was_status") == "done", F.col("status") == "done"
    kind = F.when(~was_done & is_done, "task_done").when(was_done & ~is_done, "task_undone")
    log = df.filter("patched").withColumn("kind", kind).filter("kind IS NOT NULL").select(
        "kind", "business_id", F.col("id").alias("task_id"), F.when(is_done, F.col("due_date")).otherwise(F.col("was_due_date")).alias("day"))
    days = F.array_compact(F.array("was_due_date", "due_date", F.to_date("was_done_at"), F.to_date("done_at")))
    affected = df.filter("patched").select(F.explode(days).alias("day")).distinct()
    return {"tasks": df.select(*tasks.columns), "log": log, "days": affected}
