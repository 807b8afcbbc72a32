"""robots.txt: rules per domain and decisions per URL."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def robots_state(df: DataFrame) -> DataFrame:
    """Adds state and disallow_all to robots fetches (status, NULL on a network error)."""
    status = F.col("status")
    state = F.when(status.isNull() | (status >= 500), "unreachable").when(status.between(200, 299), "ok").otherwise("missing")
    return df.withColumns({"state": state, "disallow_all": state == "unreachable"})


def robots_rules(files: DataFrame) -> DataFrame:
    """(domain, line, grp, kind, value, delay_ms) of robots files.

    kind is agent, allow, disallow, delay or sitemap; grp 0 is before any agent line. There is
    one file per domain, so a window over its lines is as large as the file.
    """
    lines = files.select("domain", F.posexplode(F.split("body", r"\r?\n")).alias("line", "raw"))
    text = F.trim(F.regexp_extract("raw", "^([^#]*)", 1))
    rows = lines.withColumn("text", text).filter(F.col("text").contains(":")).select(
        "domain", "line", F.lower(F.trim(F.substring_index("text", ":", 1))).alias("field"),
        F.trim(F.regexp_extract("text", "^[^:]*:(.*)$", 1)).alias("value"))
    in_file = Window.partitionBy("domain").orderBy("line")
    agent = F.col("field") == "user-agent"
    starts = agent & ~F.coalesce(F.lag(agent).over(in_file), F.lit(False))
    rows = rows.withColumn("starts", starts.cast("int")).withColumn("grp", F.sum("starts").over(in_file))
    seconds = F.regexp_extract("value", r"^\+?(\d+\.?\d*|\.\d+)", 1).try_cast("double")
    kind = (
        F.when(F.col("field") == "sitemap", F.when(F.col("value") != "", "sitemap"))
        .when(F.col("grp") == 0, None)
        .when(agent, F.when(F.col("value") != "", "agent"))
        .when(F.col("field") == "allow", "allow")
        .when(F.col("field") == "disallow", F.when(F.col("value") != "", "disallow"))
        .when(F.col("field") == "crawl-delay", F.when(seconds.isNotNull(), "delay"))
    )
    delay = F.when(F.col("field") == "crawl-delay", F.floor(seconds * 1000 + 0.5).cast("bigint"))
    value = F.when(agent, F.lower("value")).otherwise(F.col("value"))
    grp = F.when(F.col("field") == "sitemap", 0).otherwise(F.col("grp")).cast("bigint")
    return rows.withColumn("kind", kind).filter("kind IS NOT NULL").select("domain", "line", grp.alias("grp"), "kind", value.alias("value"), delay.alias("delay_ms"))


def applicable_rules(rules: DataFrame, token: str) -> DataFrame:
    """Rules and delays of the groups that apply to a crawler: the longest agent match, else `*`."""
    name = F.lit(token.lower())
    agents = rules.filter("kind = 'agent'").select("domain", "grp", F.col("value").alias("agent"))
    specific = (F.col("agent") != "*") & (name.contains(F.col("agent")) | F.col("agent").contains(name))
    scored = agents.withColumn("rank", F.when(specific, F.length("agent")).when(F.col("agent") == "*", 0)).filter("rank IS NOT NULL")
    best = scored.groupBy("domain").agg(F.max("rank").alias("rank"))
    groups = scored.join(best, ["domain", "rank"]).select("domain", "grp").distinct()
    return rules.filter("kind IN ('allow', 'disallow', 'delay')").join(groups, ["domain", "grp"])


def rule_pattern(value: Column) -> Column:
    """A robots path pattern as a regular expression: * is anything, a final $ anchors."""
    anchored = value.endswith("$")
    body = F.when(anchored, F.expr("left(value, length(value) - 1)")).otherwise(value)
    escaped = F.replace(F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1"), F.lit("*"), F.lit(".*"))
    return F.concat(F.lit("^"), escaped, F.when(anchored, "$").otherwise(""))


def robots_decision(urls: DataFrame, rules: DataFrame, token: str) -> DataFrame:
    """Adds allowed, rule and delay_ms to (domain, path) rows that carry an `id`.

    The rules of a domain are packed into one array, ordered so that the first that matches
    wins (longest, then allow); a robots file is bounded, so the array is too. Each URL row
    then needs one equi join and no shuffle of URL-rule pairs.
    """
    applied = applicable_rules(rules, token)
    size = F.length(F.regexp_replace("value", r"[*$]", ""))
    paths = applied.filter("kind <> 'delay' AND value <> ''").withColumns({"re": rule_pattern(F.col("value")), "size": size})
    deny = F.col("kind") == "disallow"
    packed = paths.groupBy("domain").agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("size")).alias("o"), deny.alias("deny"),
        F.when(deny, F.col("line")).otherwise(-F.col("line")).alias("at"), "value", "re", (~F.col("value").rlike(r"[*]|\$$")).alias("plain")))).alias("rules"))
    delays = applied.filter("kind = 'delay'").groupBy("domain").agg(F.min_by("delay_ms", F.struct("grp", -F.col("line"))).alias("delay_ms"))
    df = urls.join(packed, "domain", "left").join(delays, "domain", "left")
    target = F.when(F.coalesce(F.col("path"), F.lit("")) == "", "/").otherwise(F.col("path"))
    df = df.withColumn("_path", target)
    # most rules are plain prefixes; only those with * or a final $ need an expression
    hit = F.get(F.filter("rules", lambda r: F.when(r["plain"], F.startswith(F.col("_path"), r["value"])).otherwise(F.regexp(F.col("_path"), r["re"]))), F.lit(0))
    df = df.withColumn("_hit", hit)
    return df.withColumns({"allowed": F.coalesce(~F.col("_hit.deny"), F.lit(True)), "rule": F.col("_hit.value")}).drop("rules", "_hit", "_path")


def frontier_robots(urls: DataFrame, files: DataFrame, token: str) -> DataFrame:
    """URL frontier against the robots state and rules of its domain."""
    states = robots_state(files).select("domain", "disallow_all", "body", "state")
    rules = robots_rules(states.filter("state = 'ok'"))
    decided = robots_decision(urls, rules, token).join(states.select("domain", "disallow_all"), "domain", "left")
    closed = F.coalesce("disallow_all", F.lit(False))
    return decided.withColumns({
        "allowed": F.col("allowed") & ~closed, "rule": F.when(closed, "unavailable").otherwise(F.col("rule")),
        "delay_ms": F.when(~closed, F.col("delay_ms")),
    }).drop("disallow_all")


def sitemap_urls(col: Column) -> Column:
    """All <loc> addresses of a sitemap, entities decoded, http(s) only."""
    locs = F.transform(F.regexp_extract_all(col, F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), 1), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))
    return F.filter(locs, lambda u: u.rlike("(?i)^https?://"))
