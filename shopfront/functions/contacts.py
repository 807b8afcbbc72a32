"""Email, phone and follower-number columns."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from .score import lookup


def any_of(col: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (col.rlike(p) for p in patterns))


# ---------------------------------------------------------------- emails
def plausible_email(address: Column) -> Column:
    local = F.regexp_extract(address, r"^(.*)@([^@]*)$", 1)
    domain = F.lower(F.regexp_extract(address, r"^(.*)@([^@]*)$", 2))
    return (
        local.rlike(r"(?i)^[a-z0-9._%+-]{1,64}$")
        & (F.length(domain) <= 253)
        & ~domain.isin(dims.REJECT_EMAIL_DOMAINS)
        & ~F.lower(address).rlike(dims.FILE_EXTENSION)
        & ~any_of(local, dims.NOT_A_MAILBOX)
        & domain.rlike(r"^[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z0-9-]{2,}$")
    )


# A match can only begin at the start of a run of mailbox characters or right after the match
# before. Saying so keeps the scan linear in the text: without it every character of a long
# run is tried as a start.
_RUN_START = r"(?:\G|(?<![a-z0-9._%+-]))"
_EMAIL = "(?i)" + _RUN_START + dims.EMAIL_PATTERN.replace("+@", "++@", 1)


def find_emails(text: Column) -> Column:
    """Distinct plausible addresses of a text, in order of appearance."""
    found = F.transform(
        F.regexp_extract_all(text, F.lit(_EMAIL), 0),
        lambda a: F.regexp_replace(F.lower(a), r"[.,;:]+$", ""),
    )
    none = F.array().cast("array<string>")
    return F.when(text.contains("@"), F.array_distinct(F.filter(found, plausible_email))).otherwise(none)


_SPELLED = "(?i)" + _RUN_START + r"([a-z0-9._%+-]+)" + dims.SPELLED_AT + "([a-z0-9-]+(?:" + dims.SPELLED_DOT + "[a-z0-9-]+)+)"


MARK, MARK_END = "\u0001", "\u0002"


def mark_spelled(text: Column) -> Column:
    """Text with every `name (at) host (dot) tld` turned into name@host, the host between control characters."""
    plain = F.regexp_replace(F.regexp_replace(text, r"(?i)&#0*64;|&commat;", "@"), r"(?i)&#0*46;|&period;", ".")
    return F.regexp_replace(plain, _SPELLED, f" $1@{MARK}$2{MARK_END} ")


def finish_spelled(marked: Column) -> Column:
    """Rewrites the dots between the marks only, and joins the pieces again."""
    pieces = F.transform(F.split(marked, f"[{MARK}{MARK_END}]"), lambda piece, i: F.when(
        i % 2 == 1, F.regexp_replace(piece, "(?i)" + dims.SPELLED_DOT, ".")).otherwise(piece))
    joined = F.array_join(pieces, "")
    return F.regexp_replace(F.regexp_replace(joined, r"\s+@\s+", "@"), r"\s+\.\s+", ".")


def deobfuscate(text: Column) -> Column:
    """Turns `name (at) host (dot) tld` back into addresses."""
    return finish_spelled(mark_spelled(text))


def find_repaired(marked: Column) -> Column:
    """Addresses of a marked text. Without a mark nothing was repaired, so there is nothing new to find."""
    return F.when(marked.contains(MARK), find_emails(finish_spelled(marked))).otherwise(F.array().cast("array<string>"))


def decode_protected(hex_text: Column) -> Column:
    """Address hidden as hex: every byte XOR the first one; NULL on bad hex, a zero byte or no @."""
    text = F.trim(hex_text)
    valid = text.rlike("(?i)^([0-9a-f]{2}){2,}$")
    byte = lambda pos: F.conv(F.substr(text, pos, F.lit(2)), 16, 10).cast("int")
    codes = F.transform(F.sequence(F.lit(3), F.length(text) - 1, F.lit(2)), lambda pos: byte(pos).bitwiseXOR(byte(F.lit(1))))
    decoded = F.when(~F.array_contains(codes, 0), F.array_join(F.transform(codes, F.chr), ""))
    return F.when(valid, F.when(decoded.contains("@"), decoded))


def email_kind(address: Column) -> Column:
    local = F.lower(F.substring_index(address, "@", 1))
    return (
        F.when(local.rlike(dims.NOREPLY_MAILBOX), "noreply")
        .when(local.isin(dims.ROLE_MAILBOXES) | local.rlike(dims.ROLE_MAILBOX_PREFIX), "role")
        .otherwise("personal")
    )


# ---------------------------------------------------------------- phones
def tidy_phone(raw: Column) -> Column:
    kept = F.regexp_replace(F.regexp_replace(raw, "(?i)^tel:", ""), r"[^\d+().\-\s/]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"\s{2,}", " "), r"^\s+|\s+$", "")


def digits_of(col: Column) -> Column:
    return F.regexp_replace(col, r"\D", "")


def enough_digits(col: Column) -> Column:
    return F.length(digits_of(col)).between(7, 17)


def phone_noise(col: Column) -> Column:
    return any_of(col, dims.PHONE_NOISE) | (col.rlike(dims.YEAR) & (F.length(digits_of(col)) <= 4))


def phone_candidates(text: Column) -> Column:
    """Distinct number-like strings of a text, tidied, long enough and not noise."""
    found = F.transform(F.regexp_extract_all(text, F.lit(dims.PHONE_PATTERN), 0), tidy_phone)
    return F.array_distinct(F.filter(found, lambda v: enough_digits(v) & ~phone_noise(v)))


def _plan(code: Column) -> Column:
    """Struct (region, min_len, max_len, mobile, trunk) of a calling code, from one map literal."""
    entries = []
    for c, region, low, high, mobile in dims.CALLING_CODES:
        entries += [F.lit(c), F.struct(F.lit(region).alias("region"), F.lit(low).alias("min_len"), F.lit(high).alias("max_len"),
                                       F.lit(mobile).alias("mobile"), F.lit(region not in dims.NO_TRUNK_ZERO).alias("trunk"))]
    return F.try_element_at(F.create_map(*entries), code)


def add_phone(df: DataFrame, raw: str, country: str, out: str = "p") -> DataFrame:
    """Adds a struct (e164, country, is_mobile, reject_reason) for a raw number.

    Validity is by calling code and national length. A number written internationally
    is taken as such; otherwise the country hint is tried, then the digits as they are.
    Built in steps so that each part is computed once.
    """
    c = F.col
    codes = [row[0] for row in dims.CALLING_CODES]
    prefix = lambda n: F.when(F.substring("_digits", 1, n).isin(codes), F.substring("_digits", 1, n))
    region_code = lookup(c("_region"), {row[1]: row[0] for row in dims.CALLING_CODES}, None)
    df = df.withColumns({"_clean": tidy_phone(c(raw)), "_region": F.upper(c(country))})
    df = df.withColumns({"_explicit": c("_clean").rlike(r"^(\+|00)"), "_digits": digits_of(F.regexp_replace("_clean", "^00", "")),
                         "_national": digits_of(c("_clean")), "_home": region_code})
    df = df.withColumn("_code", F.coalesce(prefix(3), prefix(2), prefix(1)))
    df = df.withColumns({"_plan_home": F.when(~c("_explicit"), _plan(c("_home"))), "_plan_code": _plan(c("_code"))})
    cut = lambda text, plan: F.when(c(plan + ".trunk"), F.regexp_replace(text, "^0", "")).otherwise(text)
    df = df.withColumns({"_nat_home": cut(c("_national"), "_plan_home"),
                         "_nat_code": cut(F.substr(c("_digits"), F.length("_code") + 1), "_plan_code")})
    fits = lambda text, plan: F.coalesce(F.length(text).between(c(plan + ".min_len"), c(plan + ".max_len")), F.lit(False))
    df = df.withColumns({"_fits_home": fits("_nat_home", "_plan_home"), "_fits_code": fits("_nat_code", "_plan_code")})
    reject = (
        F.when(~enough_digits(c("_clean")), "too_few_digits").when(phone_noise(c("_clean")), "not_a_phone")
        .when(c("_fits_home") | c("_fits_code"), None)
        .when(c("_explicit") | c("_region").isNotNull(), "unparseable").otherwise("country_unknown")
    )
    df = df.withColumn("_reject", reject)
    pick = lambda home, code: F.when(c("_reject").isNull(), F.when(c("_fits_home"), home).otherwise(code))
    df = df.withColumns({"_cc": pick(c("_home"), c("_code")), "_nat": pick(c("_nat_home"), c("_nat_code")), "_p": pick(c("_plan_home"), c("_plan_code"))})
    mobile = F.when(c("_p.mobile") == "", c("_cc") == "1").otherwise(F.regexp(c("_nat"), c("_p.mobile")))
    df = df.withColumn(out, F.struct(
        F.concat(F.lit("+"), c("_cc"), c("_nat")).alias("e164"), c("_p.region").alias("country"),
        F.coalesce(mobile, F.lit(False)).alias("is_mobile"), c("_reject").alias("reject_reason")))
    return df.drop("_clean", "_region", "_explicit", "_digits", "_national", "_home", "_code", "_plan_home", "_plan_code", "_nat_home", "_nat_code",
                   "_fits_home", "_fits_code", "_reject", "_cc", "_nat", "_p")


# ------------------------------------------------------------- followers
def human_number(col: Column) -> Column:
    """'1,234', '1.2K', '3.4M subscribers' as a whole number; NULL when it is not one."""
    text = F.regexp_replace(F.lower(F.trim(col)), r"\s+", " ")
    pattern = r"(\d[\d\s.,]*)\s*(k|m|b|mil|mn|thousand|million|billion)?"
    digits = F.regexp_replace(F.regexp_extract(text, pattern, 1), r"\s", "")
    unit = F.substring(F.regexp_extract(text, pattern, 2), 1, 1)
    split = r"^(.*)[.,](\d{1,2})$"
    number = F.when(digits.rlike(split), F.concat_ws(".", F.regexp_extract(digits, split, 1), F.regexp_extract(digits, split, 2))
                    ).otherwise(F.regexp_replace(digits, "[.,]", ""))
    factor = F.when(unit.isin("k", "t"), 1e3).when(unit == "m", 1e6).when(unit == "b", 1e9).otherwise(1.0)
    value = F.when(number.rlike(r"^\d+(\.\d+)?$"), number.try_cast("double"))
    return F.floor(value * factor + 0.5).cast("bigint")


def _first(html: Column, pattern: str) -> Column:
    """First group of the first match, NULL when there is none."""
    return F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))


def _written_counts(html: Column) -> dict[str, list[Column]]:
    """Per platform, where a follower count is written: in the page's data, then before a word of its description."""
    said = lambda word: [_first(F.regexp_extract(html, tag, 1), rf"(?i)([\d.,]+\s*[KMB]?)\s*{word}") for tag in dims.DESCRIPTION_TAGS]
    return {
        name: [*(_first(html, p) for p in patterns), *(c for word in dims.DESCRIBED_WORDS.get(name, ()) for c in said(word))]
        for name, patterns in dims.FOLLOWER_COUNTS.items()
    }


def add_followers(df: DataFrame, platform: str, html: str, out: str = "f", wall_limits: dict[str, int] | None = dims.WALL_LIMITS) -> DataFrame:
    """Adds a struct (followers, state, reason, has_video) read from a saved profile page.

    The places a count may be written become one array per platform, read as numbers once;
    the first that is a number wins. A page that shows a login wall instead counts as
    blocked while it is shorter than the platform's wall limit, or at any length where wall_limits
    is None. Other platforms are unsupported.
    """
    kind, page = F.col(platform), F.col(html)
    by_kind = lambda mapping: lookup(kind, mapping, None)
    written = None
    for name, places in _written_counts(page).items():
        written = F.when(kind == name, F.array(*places)) if written is None else written.when(kind == name, F.array(*places))
    number = lambda text: human_number(F.regexp_replace(text, "(?i)subscribers?", ""))
    df = df.withColumn("_count", F.get(F.filter(F.transform(written, number), lambda n: n.isNotNull()), F.lit(0)))
    plays = F.when(kind == "youtube", _first(page, r'(?i)itemprop="interactionCount"[^>]*content="(\d+)"').try_cast("bigint"))
    size = F.length(page)
    df = df.withColumns({
        "_total": F.coalesce("_count", plays),
        "_captcha": (kind == "tiktok") & page.rlike("(?i)" + dims.CAPTCHA_WALL) & ((size < 20000) if wall_limits else F.lit(True)),
        "_wall": page.rlike("(?i)" + dims.LOGIN_WALL) & ((size < by_kind(wall_limits)) if wall_limits else F.lit(True)),
    })
    known, supported = F.col("_total").isNotNull(), kind.isin(list(dims.WALL_LIMITS))
    blocked = F.coalesce(F.col("_captcha") | F.col("_wall"), F.lit(False))
    policy = F.coalesce(lookup(kind, {p: r for p, (_, r) in dims.PLATFORM_POLICY.items() if r}, None), F.lit("unsupported"))
    state = F.when(known, "known").when(~supported, "unsupported").when(blocked, "blocked").otherwise("unknown")
    by_firewall = (kind == "youtube") | F.col("_captcha")
    reason = (F.when(known, None).when(~supported, policy).when(blocked, F.when(by_firewall, "blocked_by_waf").otherwise("platform_requires_auth"))
              .otherwise("no_count_in_markup"))
    video = (
        F.when((kind == "youtube") & F.col("_count").isNotNull(), page.rlike('"videoId"|"videosCountText"|"richMetadata"'))
        .when((kind == "tiktok") & known, page.rlike(r'"videoCount":\s*([1-9]\d*)|"itemListElement"'))
        .when((kind == "instagram") & ~known, page.rlike('"video_view_count"|"is_video":true'))
    )
    result = F.struct(F.col("_total").alias("followers"), state.alias("state"), reason.alias("reason"),
                      F.coalesce(video, F.lit(False)).alias("has_video"))
    return df.withColumn(out, result).drop("_count", "_total", "_captcha", "_wall")
