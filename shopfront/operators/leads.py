"""The lead table: child summaries, score, search, feed and detail."""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import score as S
from ..functions.urls import fold_accents
from .ordered import top_per_key


# -------------------------------------------------------- child summaries
def email_choice() -> Column:
    """Order of choice: role, then personal, then other; higher confidence; lower id."""
    rank = F.when(F.col("kind") == "role", 0).when(F.col("kind") == "personal", 1).otherwise(2)
    return F.struct(rank, -F.col("confidence"), F.col("id"))


def primary_email(emails: DataFrame) -> DataFrame:
    return emails.groupBy("business_id").agg(F.min_by("address", email_choice()).alias("email"))


def primary_phone(phones: DataFrame) -> DataFrame:
    best = F.struct(-F.col("confidence"), F.col("id"))
    return phones.groupBy("business_id").agg(
        F.min_by("e164", F.when(F.col("e164").isNotNull(), best)).alias("phone_e164"), F.min_by("raw", best).alias("phone_raw"))


def phone_summary(phones: DataFrame) -> DataFrame:
    best = F.struct(-F.col("confidence"), F.col("id"))
    return phones.groupBy("business_id").agg(
        F.count("e164").alias("n_e164"), F.min_by("e164", F.when(F.col("e164").isNotNull(), best)).alias("phone_e164"),
        F.min_by("raw", best).alias("phone_raw"))


def email_summary(emails: DataFrame) -> DataFrame:
    return emails.groupBy("business_id").agg(
        F.count_if(F.col("kind") != "noreply").alias("n_usable"), F.min_by("address", email_choice()).alias("email"))


def social_summary(socials: DataFrame) -> DataFrame:
    known = S.known_followers()
    return socials.groupBy("business_id").agg(
        F.count(known).alias("followers_known"), F.sum(known).alias("followers_total"), F.max(known).alias("top_followers"),
        F.count_if("has_video").alias("video_platforms"))


def denorm(leads: DataFrame, phones: DataFrame, emails: DataFrame, socials: DataFrame) -> DataFrame:
    """Lead table with its child summaries.

    One partially aggregated pass per child table, joined on the lead id: the children are
    already partitioned by that id, so only the leads move once more.
    """
    keyed = lambda df: df.withColumnRenamed("business_id", "id")
    df = leads.join(keyed(phone_summary(phones)), "id", "left").join(keyed(email_summary(emails)), "id", "left")
    df = df.join(keyed(social_summary(socials)).withColumn("_social", F.lit(True)), "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return df.withColumns({
        "has_phone": zero("n_e164") > 0, "has_email": zero("n_usable") > 0,
        "has_social": F.coalesce("_social", F.lit(False)),
        "followers_known": zero("followers_known"), "video_platforms": zero("video_platforms"),
        "tier": S.magnitude_tier(F.col("top_followers")),
        "has_website": F.col("website_url").isNotNull() & ~F.col("site_state").isin("no_tag", "social_only"),
    }).drop("n_e164", "n_usable", "_social", "top_followers")


def has_child(leads: DataFrame, phones: DataFrame, emails: DataFrame, socials: DataFrame) -> DataFrame:
    """The three EXISTS flags only, from distinct ids."""
    ids = lambda df, flag: df.select(F.col("business_id").alias("id")).distinct().withColumn(flag, F.lit(True))
    df = leads.join(ids(phones.filter("e164 IS NOT NULL"), "has_phone"), "id", "left")
    df = df.join(ids(emails.filter("kind <> 'noreply'"), "has_email"), "id", "left")
    df = df.join(ids(socials, "has_social"), "id", "left")
    return df.withColumns({f: F.coalesce(f, F.lit(False)) for f in ("has_phone", "has_email", "has_social")})


def scored(leads: DataFrame, preset: str = "websites") -> DataFrame:
    return leads.withColumns({"score": S.score(preset), "confidence_pct": S.confidence_pct(), "score_reasons": S.score_reasons()})


def rescore_all(leads: DataFrame, preset: str = "websites", version: int = dims.SCORE_VERSION, now: str = "1970-01-01") -> DataFrame:
    return scored(leads, preset).withColumns({"score_version": F.lit(version), "scored_at": F.lit(now).cast("timestamp")})


def preset_compare(leads: DataFrame) -> DataFrame:
    """(id, preset, score, rank) under every preset.

    A score has at most 101 values, so the rank is read off a table of counts per
    (preset, score), never more than 303 rows, instead of sorting all leads.
    """
    scores = F.array(*(F.struct(F.lit(p).alias("preset"), S.score(p).alias("score")) for p in dims.PRESET_POINTS))
    rows = leads.select("id", F.explode(scores).alias("s")).select("id", "s.*")
    counts = rows.groupBy("preset", "score").agg(F.count("*").alias("n"))
    above = counts.alias("a").join(counts.alias("b"), (F.col("a.preset") == F.col("b.preset")) & (F.col("b.score") > F.col("a.score")), "left")
    ranks = above.groupBy(F.col("a.preset").alias("preset"), F.col("a.score").alias("score")).agg(
        (F.coalesce(F.sum("b.n"), F.lit(0)) + 1).alias("rank"))
    return rows.join(F.broadcast(ranks), ["preset", "score"]).select("id", "preset", "score", "rank")


def score_grid(spark) -> DataFrame:
    """Every combination of preset, state, flags, tier and stage, with its score."""
    flags = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0), (1, 1, 1), (0, 0, 1)]
    combos = spark.range(1).select(F.explode(F.array(*map(F.lit, dims.SITE_STATES))).alias("site_state"))
    combos = combos.withColumn("f", F.explode(F.array(*(F.struct(*(F.lit(bool(v)).alias(n) for v, n in zip(
        f, ("has_phone", "has_email", "has_social")))) for f in flags)))).select("site_state", "f.*")
    combos = combos.withColumn("tier", F.explode(F.array(*map(F.lit, dims.TIER_POINTS))))
    combos = combos.withColumn("enrichment_stage", F.explode(F.array(*map(F.lit, dims.ENRICHMENT_STAGES))))
    scores = F.array(*(F.struct(F.lit(p).alias("preset"), S.score(p).alias("score")) for p in dims.PRESET_POINTS))
    return combos.withColumn("s", F.explode(scores)).select(*combos.columns, "s.*")


def stale_scores(leads: DataFrame, version: int = dims.SCORE_VERSION) -> DataFrame:
    stale = ~F.col("score_version").eqNullSafe(F.lit(version)) | F.col("scored_at").isNull()
    return leads.agg(F.count_if(stale).alias("n"))


# ------------------------------------------------------- filter and search
def lead_filter(leads: DataFrame, category: str | None = None, site_states: list[str] | None = None, no_website: bool = False,
                has_email: bool = False, has_phone: bool = False, has_social: bool = False, min_score: int | None = None,
                stage: str | None = None) -> DataFrame:
    if category and category != "all":
        leads = leads.filter(F.col("category") == category)
    if site_states:
        leads = leads.filter(F.col("site_state").isin(site_states))
    if no_website:
        leads = leads.filter(F.col("site_state").isin(dims.NO_SITE_STATES))
    for wanted, flag in ((has_email, "has_email"), (has_phone, "has_phone"), (has_social, "has_social")):
        if wanted:
            leads = leads.filter(F.col(flag))
    if min_score is not None:
        leads = leads.filter(F.col("score") >= min_score)
    if stage:
        leads = leads.filter(F.col("pipeline_stage") == stage)
    return leads


def search_tokens(col: Column) -> Column:
    """Words of a text, case and accents folded."""
    return F.filter(F.split(F.lower(fold_accents(col)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def lead_search(leads: DataFrame, q: str) -> DataFrame:
    """Leads where every query word starts some word of the name or address.

    A query with nothing but punctuation falls back to a substring test on the name.
    """
    q = q.strip()
    if not q:
        return leads
    words = [w for w in re.sub(r"[^\w\s]|_", " ", q).split() if w]
    if not words:
        return leads.filter(F.col("name").ilike(f"%{q}%"))
    text = F.concat_ws(" ", "name", "address_line")
    for word in words:
        leads = leads.filter(F.exists(search_tokens(text), _starts(F.lower(fold_accents(F.lit(word))))))
    return leads


def _starts(prefix: Column):
    return lambda token: token.startswith(prefix)


# ------------------------------------------------------------------- feed
def feed_order(sort: str = "score") -> list[Column]:
    """Sort keys of the feed; id breaks ties so that pages never overlap."""
    c = F.col
    contacts = c("has_phone").cast("int") + c("has_email").cast("int")
    return {
        "name": [c("name").asc(), c("id").asc()],
        "recent": [c("first_seen_at").desc(), c("id").asc()],
        "followers": [c("followers_total").desc_nulls_last(), c("score").desc(), c("id").asc()],
    }.get(sort, [c("score").desc(), contacts.desc(), c("name").asc(), c("id").asc()])


def feed_sort(leads: DataFrame, sort: str = "score") -> DataFrame:
    return leads.orderBy(*feed_order(sort))


def feed_page(leads: DataFrame, page: int = 1, size: int = 25, sort: str = "score") -> tuple[DataFrame, DataFrame]:
    """(rows of one page, one-row total). The page is a top-k, not a full sort."""
    page, size = max(1, page), min(100, max(1, size))
    rows = feed_sort(leads, sort).offset((page - 1) * size).limit(size)
    return rows, leads.agg(F.count("*").alias("total"))


def lead_projection(leads: DataFrame) -> DataFrame:
    return leads.select(
        "id", "name", "category", "category_label", "city", "country_code", "score", "confidence_pct", "site_state",
        "website_url", "website_domain", "has_website", F.coalesce("phone_e164", "phone_raw").alias("phone"), "email",
        "has_phone", "has_email", "has_social", "followers_total", "followers_known",
        (F.coalesce("video_platforms", F.lit(0)) > 0).alias("has_video"), "pipeline_stage", "enrichment_state", "first_seen_at")


def lead_socials(leads: DataFrame, socials: DataFrame) -> DataFrame:
    """Leads with their social accounts, one row per account; a lead without any keeps one row.

    Flat, so that a lead with very many accounts never has to fit into one value.
    """
    s = socials.select(F.col("business_id").alias("id"), "platform", "url", "handle", F.col("id").alias("social_id"))
    return leads.join(s, "id", "left")


def best_lead(leads: DataFrame, sort: str = "score") -> DataFrame:
    return feed_sort(leads, sort).limit(1)


def best_by_family(leads: DataFrame) -> DataFrame:
    """Best lead without a working site and best lead with one."""
    family = F.when(F.col("site_state").isin(dims.NO_SITE_STATES), "no_site").when(
        F.col("site_state").isin(dims.SCRAPEABLE_STATES), "live")
    contacts = F.col("has_phone").cast("int") + F.col("has_email").cast("int")
    order = F.struct(-F.col("score"), -contacts, F.col("name"), F.col("id"))
    return leads.withColumn("family", family).filter("family IS NOT NULL").groupBy("family").agg(
        F.min_by(F.struct("id", "name", "score"), order).alias("b")).select("family", "b.*")


def lead_detail(leads: DataFrame, phones: DataFrame, emails: DataFrame, socials: DataFrame, tasks: DataFrame, n_tasks: int = 50) -> DataFrame:
    """Leads with child counts, parsed evidence and the latest tasks (at most n_tasks, so safe to nest)."""
    count = lambda df, name: df.groupBy(F.col("business_id").alias("id")).agg(F.count("*").alias(name))
    latest = top_per_key(tasks.filter("business_id IS NOT NULL"), ["business_id"], [F.col("created_at").desc(), F.col("id").desc()], n_tasks)
    nested = latest.groupBy(F.col("business_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("created_at", F.col("id").alias("task_id"), "title", "status")), asc=False).alias("tasks"))
    df = leads
    for child, name in ((emails, "n_emails"), (phones, "n_phones"), (socials, "n_socials")):
        df = df.join(count(child, name), "id", "left")
    df = df.join(nested, "id", "left")
    df = df.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("n_emails", "n_phones", "n_socials")})
    return df.withColumns({
        "tasks": F.coalesce("tasks", F.array().cast("array<struct<created_at:timestamp,task_id:bigint,title:string,status:string>>")),
        "evidence": F.coalesce(F.from_json("parking_evidence", "array<string>"), F.array().cast("array<string>")),
    })


def lead_children(phones: DataFrame, emails: DataFrame, socials: DataFrame) -> DataFrame:
    """All contact rows of all leads in one tall table (business_id, kind, value, confidence)."""
    rows = lambda df, kind, value, conf: df.select("business_id", F.lit(kind).alias("kind"), value.alias("value"), conf.alias("confidence"))
    none = F.lit(None).cast("bigint")
    return rows(emails, "email", F.col("address"), F.col("confidence")).unionByName(
        rows(phones, "phone", F.coalesce("e164", "raw"), F.col("confidence"))).unionByName(
        rows(socials, "social", F.col("url"), none))
