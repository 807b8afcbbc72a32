"""URL, host, name and day columns.

These follow browser URL rules for the forms found in map data and web pages:
default scheme, lower-cased host, tracking parameters removed, fragment dropped.
Not covered: dot segments, and international host names, which stay as written.
"""
from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims

_TRACKING = "(?i)(?:" + "|".join(dims.TRACKING_PARAMS) + ")"
_SHARE = "(?i)(?:" + "|".join(dims.SHARE_PATHS) + ")"
_PARTS = r"^(?i:https?)://([^/?#\\]*)([^?#]*)(\?[^#]*)?"


def strip(col: Column) -> Column:
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def strip_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def normalize_host(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(col)), r"\.$", ""), r":\d+$", "")


def _params(query: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(query, r"^\?", ""), "&"), lambda p: p != "")


def _param_name(param: Column) -> Column:
    return F.regexp_extract(param, "^([^=]*)", 1)


def _with_equals(param: Column) -> Column:
    return F.when(param.contains("="), param).otherwise(F.concat(param, F.lit("=")))


def _untracked(params: Column) -> Column:
    return F.filter(params, lambda p: ~_param_name(p).rlike(_TRACKING))


def _query_text(params: Column) -> Column:
    joined = F.array_join(F.transform(params, _with_equals), "&")
    return F.when(F.size(params) > 0, F.concat(F.lit("?"), joined)).otherwise("")


def percent_encode(path: Column) -> Column:
    """Percent-encode what a browser would: blanks, quotes, brackets and non-ASCII characters."""
    bad = r'[^\x21-\x7e]|["<>`{}]'
    encoded = F.array_join(F.transform(F.split(path, ""), lambda ch: F.when(
        ch.rlike(bad), F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20"))).otherwise(ch)), "")
    return F.when(path.rlike(bad), encoded).otherwise(path)


def resolve_dots(path: Column) -> Column:
    """A path without `.` and `..` segments, as a browser resolves them; others are left as they are."""
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")
    kept = F.aggregate(segments, F.array().cast("array<string>"), lambda out, s: F.when(s == ".", out)
                       .when(s == "..", F.slice(out, F.lit(1), F.greatest(F.lit(0), F.size(out) - 1))).otherwise(F.concat(out, F.array(s))))
    # a path that ends in a dot segment names a folder
    ends = F.when(path.rlike(r"/\.\.?$") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), ends)).otherwise(path)


def url_parts(df: DataFrame, col: str, prefix: str = "u_") -> DataFrame:
    """Adds scheme, host (with www), port, path and query of an http(s) URL; all NULL if it is not one."""
    p = lambda n: F.col(prefix + n)
    text = strip(F.col(col))
    bad = F.coalesce(text, F.lit("")).rlike(r"(?i)^(?:$|mailto:|tel:|javascript:|#)")
    full = F.when(bad, None).when(text.rlike("(?i)^https?://"), text).otherwise(F.concat(F.lit("https://"), text))
    df = df.withColumn(prefix + "full", full)
    authority = F.regexp_replace(F.regexp_extract(p("full"), _PARTS, 1), "^.*@", "")
    df = df.withColumns({
        prefix + "scheme": F.lower(F.regexp_extract(p("full"), "^([A-Za-z]+):", 1)),
        prefix + "host": F.lower(F.regexp_replace(authority, r":\d*$", "")),
        prefix + "port": F.regexp_extract(authority, r":(\d+)$", 1),
        prefix + "path": resolve_dots(percent_encode(F.regexp_extract(p("full"), _PARTS, 2))),
        prefix + "query": percent_encode(F.regexp_extract(p("full"), _PARTS, 3)),
    })
    valid = p("full").isNotNull() & p("host").rlike(r"^[^\s%<>\[\]^|:]+$")
    default_port = ((p("scheme") == "https") & (p("port") == "443")) | ((p("scheme") == "http") & (p("port") == "80"))
    null_unless = lambda c: F.when(valid, c)
    return df.withColumns({
        prefix + "port": null_unless(F.when((p("port") == "") | default_port, "").otherwise(F.concat(F.lit(":"), p("port")))),
        prefix + "path": null_unless(F.when(p("path") == "", "/").otherwise(p("path"))),
        prefix + "scheme": null_unless(p("scheme")),
        prefix + "query": null_unless(p("query")),
        prefix + "host": null_unless(p("host")),
    }).drop(prefix + "full")


def cache_key(df: DataFrame, col: str, out: str = "cache_key") -> DataFrame:
    """One key for all tracking variants and parameter orders of a page."""
    df = url_parts(df, col, "ck_")
    by_name = lambda a, b: F.when(_param_name(a) < _param_name(b), -1).when(_param_name(a) > _param_name(b), 1).otherwise(0)
    params = F.array_sort(_untracked(_params(F.col("ck_query"))), by_name)
    key = F.concat(F.col("ck_scheme"), F.lit("://"), strip_www(F.col("ck_host")), F.col("ck_port"), F.col("ck_path"),
                   _query_text(params))
    return df.withColumn(out, key).drop("ck_scheme", "ck_host", "ck_port", "ck_path", "ck_query")


def registrable_domain(host: Column) -> Column:
    """The registrable domain, by a curated public-suffix list; NULL for addresses and bare suffixes."""
    last_two = F.substring_index(host, ".", -2)
    n_labels = F.size(F.split(host, r"\."))
    return (
        F.when(host.rlike(r"^\d+(\.\d+){3}$") | (n_labels < 2), None)
        .when(last_two.isin(dims.TWO_LABEL_SUFFIXES), F.when(n_labels > 2, F.substring_index(host, ".", -3)))
        .otherwise(last_two)
    )


def host_suffixes(host: Column) -> Column:
    """host, then each parent domain: a.b.c -> [a.b.c, b.c, c]."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def under_any(host: Column, names: list[str]) -> Column:
    """host equals a name or lies under one: a set lookup per parent domain, not one test per name."""
    return F.coalesce(F.exists(host_suffixes(host), lambda s: s.isin(names)), F.lit(False))


def is_free_host(host: Column) -> Column:
    return under_any(host, dims.FREE_HOST_SUFFIXES)


def social_platform(host: Column) -> Column:
    from .score import lookup

    by_host = lookup(host, dims.SOCIAL_HOSTS, None)
    return F.coalesce(by_host, lookup(registrable_domain(host), dims.SOCIAL_HOSTS, None))


def is_link_hub(host: Column) -> Column:
    return F.coalesce(host.isin(dims.LINK_HUB_HOSTS) | registrable_domain(host).isin(dims.LINK_HUB_HOSTS), F.lit(False))


def share_widget(path: Column) -> Column:
    return path.rlike(_SHARE)


def social_handle(platform: Column, path: Column, query: Column) -> Column:
    segs = F.filter(F.split(path, "/"), lambda s: s != "")
    first, second = F.get(segs, F.lit(0)), F.get(segs, F.lit(1))
    pair = lambda kinds: F.when(first.isin(kinds) & second.isNotNull(), F.lower(F.concat_ws("/", first, second)))
    digits = F.regexp_replace(first, r"\D", "")
    return F.when(F.size(segs) == 0, None).when(
        platform.isin("instagram", "threads"),
        F.when(~first.isin("p", "reel", "reels", "explore", "stories", "tv"), F.lower(first)),
    ).when(
        platform == "facebook", F.when(~first.isin("pages", "groups", "profile.php", "people"), F.lower(first))
    ).when(
        platform == "tiktok", F.nullif(F.lower(F.regexp_replace(first, "^@", "")), F.lit(""))
    ).when(
        platform == "twitter", F.when(~first.isin("i", "home", "search", "hashtag", "intent"), F.lower(first))
    ).when(platform == "linkedin", pair(["company", "in", "school", "showcase"])).when(
        platform == "youtube", F.when(first.startswith("@"), F.lower(first)).otherwise(pair(["channel", "c", "user"]))
    ).when(platform == "whatsapp", F.nullif(digits, F.lit(""))).when(
        platform.isin("telegram", "pinterest"), F.lower(first)
    )


def url_identity(df: DataFrame, col: str, prefix: str = "n_") -> DataFrame:
    """Adds the normalised URL, host, domain, dedupe key and social identity of a URL column.

    Every added column is NULL where the value is not a usable web address.
    """
    df = url_parts(df, col, "u_")
    p = lambda n: F.col(prefix + n)
    host = strip_www(F.col("u_host"))
    df = df.withColumn(prefix + "host", F.when(host.contains("."), host))
    params = _params(F.col("u_query"))
    kept = _untracked(params)
    query = F.when(F.size(kept) == F.size(params), F.col("u_query")).otherwise(_query_text(kept))
    url = F.concat(F.col("u_scheme"), F.lit("://"), F.col("u_host"), F.col("u_port"), F.col("u_path"), query)
    df = df.withColumns({
        prefix + "url": F.when(p("host").isNotNull(), url),
        prefix + "domain": registrable_domain(p("host")),
        prefix + "platform": social_platform(p("host")),
        prefix + "is_hub": is_link_hub(p("host")),
    })
    df = df.withColumns({
        prefix + "dedupe_key": F.when(is_free_host(p("host")), p("host")).otherwise(F.coalesce(p("domain"), p("host"))),
        prefix + "is_social": p("platform").isNotNull(),
        prefix + "handle": F.when(p("platform").isNotNull(), social_handle(p("platform"), F.col("u_path"), F.col("u_query"))),
        prefix + "share": F.coalesce(p("platform").isNotNull() & share_widget(F.col("u_path")), F.lit(False)),
    })
    return df.drop("u_scheme", "u_host", "u_port", "u_path", "u_query")


def _latin_marks() -> tuple[str, str]:
    """Accented letters and the plain letter each decomposes to, by the Unicode rule."""
    source, target = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            source.append(chr(code))
            target.append(plain)
    return "".join(source), "".join(target)


def fold_accents(col: Column) -> Column:
    source, target = _latin_marks()
    return F.regexp_replace(F.translate(col, source, target), "[̀-ͯ]", "")


def normalize_name(col: Column, nfkd: bool = False) -> Column:
    """Comparable form of a business name: no accents, case, legal words or punctuation.

    nfkd=True decomposes all scripts (an Arrow UDF); the default covers Latin letters in the JVM.
    """
    if nfkd:
        @F.pandas_udf("string")
        def decompose(values: pd.Series) -> pd.Series:
            return values.str.normalize("NFKD")

        plain = F.regexp_replace(decompose(col), "[̀-ͯ]", "")
    else:
        plain = fold_accents(col)
    words = F.regexp_replace(F.lower(plain), r"\b(" + "|".join(dims.LEGAL_WORDS) + r")\b\.?", "")
    return F.trim(F.regexp_replace(words, "[^a-z0-9]+", " "))


def local_day(ts: Column) -> Column:
    """Calendar day in the session time zone."""
    return F.to_date(ts)


def error_kind(col: Column) -> Column:
    rules = [("ENOTFOUND|EAI_AGAIN", "dns_fail"), ("ECONNREFUSED", "refused"), ("CERT|TLS|SSL", "tls"),
             ("ETIMEDOUT|UND_ERR_CONNECT_TIMEOUT|timed? ?out", "timeout"),
             ("UND_ERR_SOCKET|ECONNRESET|EPIPE", "socket"), (r"^(TimeoutError|AbortError)\b", "timeout")]
    out = F.when(col.isNull(), None)
    for pattern, kind in rules:
        out = out.when(col.rlike("(?i)" + pattern if not pattern.startswith("^") else pattern), kind)
    return out.otherwise("unknown")
