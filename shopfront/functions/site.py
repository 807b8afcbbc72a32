"""What a saved homepage says about the state of a website."""
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from .urls import normalize_host, under_any


def mentions(lower: Column, pattern: str) -> Column:
    """A lower-cased text contains the pattern.

    A pattern of plain alternatives becomes substring tests, about ten times faster than a
    case-insensitive regular expression over a whole page.
    """
    words = [w.replace(r"\.", ".") for w in pattern.split("|")]
    if any(re.search(r"[\\\[\](){}?*+^$.]", w.replace(".", "")) for w in words):
        return lower.rlike(pattern)
    return reduce(lambda a, b: a | b, (lower.contains(w.lower()) for w in words))


def site_platform(lower: Column, server: Column) -> Column:
    """First matching site builder in the lower-cased page, else the web server of the header."""
    out = F.when(F.coalesce(lower, F.lit("")) == "", None)
    for name, pattern in dims.SITE_PLATFORMS:
        out = out.when(mentions(lower, pattern), name)
    for name, pattern in dims.SERVER_PLATFORMS:
        out = out.when(server.rlike("(?i)" + pattern), name)
    return out


def site_title(html: Column) -> Column:
    title = F.regexp_extract(html, r"(?i)<title[^>]*>([\s\S]*?)</title>", 1)
    return F.nullif(F.trim(F.regexp_replace(title, r"\s+", " ")), F.lit(""))


def has_video(lower: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, (mentions(lower, p) for p in dims.VIDEO_MARKERS)), F.lit(False))


def links_to_own_host(html: Column, final_url: Column) -> Column:
    host = lambda url: normalize_host(F.regexp_extract(url, r"(?i)^https?://([^/?#]*)", 1))
    absolute = F.regexp_extract_all(html, F.lit(r"""(?i)href=["'](https?://[^"']+)["']"""), 1)
    return F.exists(absolute, lambda link: host(link) == host(final_url))


def site_verdict(df: DataFrame) -> DataFrame:
    """Adds site_state, evidence and thin.

    Reads status, error_kind, redirect_hosts (array), html, server, final_url, has_ssl and
    robots_blocked. The first rule that holds decides.
    """
    html, status = F.col("html"), F.coalesce(F.col("status"), F.lit(0))
    parked_host = F.get(F.filter(F.col("redirect_hosts"), lambda h: under_any(h, dims.PARKING_HOSTS)), F.lit(0))
    has_body = F.coalesce(html, F.lit("")) != ""
    df = df.withColumns({
        "v_lower": F.lower(html),
        "v_parked_host": parked_host,
        "v_parses": ~F.col("robots_blocked") & status.between(200, 299) & has_body
        & ~F.coalesce(F.col("error_kind") == "too_many_redirects", F.lit(False)),
    })
    df = df.withColumn("v_own_links", F.when(F.col("v_parses"), links_to_own_host(html, F.col("final_url"))))
    thin = F.col("v_parses") & (F.length(html) < dims.THIN_PAGE_CHARS)
    kb = F.greatest(F.lit(1), F.floor(F.length(html) / 1024 + 0.5))
    lower = F.col("v_lower")
    said = [F.when(mentions(lower, pattern), label) for pattern, label in dims.PARKING_PHRASES]
    redirected = F.when(F.col("v_parked_host").isNotNull(),
                        F.concat(F.lit("redirected to parking host "), F.col("v_parked_host")))
    page_evidence = F.array_compact(F.array(
        redirected, *said,
        F.when(F.col("server").rlike("(?i)parking"), F.concat(F.lit('server header reports "'), F.col("server"), F.lit('"'))),
        F.when(thin & ~F.col("v_own_links"),
               F.concat(F.lit("page is only "), kb.cast("string"), F.lit(" KB and links to no page of its own"))),
    ))
    no_status = (status == 0) & F.col("error_kind").isNotNull()
    dns = no_status & (F.col("error_kind") == "dns_fail")
    evidence = (
        F.when(F.col("v_parses"), page_evidence)
        .when(F.col("robots_blocked"), F.array().cast("array<string>"))
        .otherwise(F.array_compact(F.array(redirected, F.when(dns, "domain does not resolve"))))
    )
    df = df.withColumns({"evidence": evidence, "thin": thin})
    state = (
        F.when(F.col("robots_blocked"), "robots_disallowed")
        .when(no_status, F.when(F.col("error_kind") == "refused", "server_down")
              .when(F.col("error_kind").isin("timeout", "too_many_redirects"), F.col("error_kind")).otherwise("dead"))
        .when(F.col("v_parked_host").isNotNull() & status.between(300, 399), "parked")
        .when(F.col("error_kind") == "too_many_redirects", "too_many_redirects")
        .when(status.isin(401, 403, 429), "blocked")
        .when(status.isin(404, 410), "dead")
        .when(status >= 500, "server_error")
        .when(~status.between(200, 299), "dead")
        .when(~has_body, "unknown")
        .when(F.size("evidence") >= 2, "parked")
        .when(~F.col("has_ssl"), "live_insecure")
        .when(F.col("thin") | ~F.col("v_own_links"), "live_weak")
        .otherwise("live")
    )
    return df.withColumn("site_state", state).drop("v_lower", "v_parked_host", "v_parses", "v_own_links")
