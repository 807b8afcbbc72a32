"""Batch enrichment over saved pages and profiles: probe, extract, follow, check."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import contacts as C
from ..functions import html as H
from ..functions import site as T
from ..functions import urls as U
from .arrays import keep, unnest, unnest_with_position
from .ordered import first_per_key, left_join_known, top_per_key
from .spread import spread

HTML_TYPES = "(?i)text/html|application/xhtml"


def parseable(pages: DataFrame) -> DataFrame:
    """Pages with a body of an HTML type."""
    kind = F.col("content_type").isNull() | F.col("content_type").rlike(HTML_TYPES)
    return pages.filter(F.col("html").isNotNull() & (F.col("html") != "") & kind)


# ------------------------------------------------------------------ probe
def site_facts(pages: DataFrame) -> DataFrame:
    """Adds platform, title and has_video. The page is lower-cased once for all the marker tests."""
    lower = F.col("_lower")
    df = pages.withColumn("_lower", F.lower("html"))
    return df.withColumns({"platform": T.site_platform(lower, F.col("server")), "title": T.site_title(F.col("html")),
                           "has_video": T.has_video(lower)}).drop("_lower")


FACTS = ["probed_state", "evidence", "platform", "title", "has_video", "http_status", "has_ssl", "final_url"]


def page_facts(pages: DataFrame) -> DataFrame:
    """Adds the FACTS columns: what a probe of the page finds, a redirect loop overriding the rest.

    Pages carry status, error_kind, redirect_hosts, hops, html, server, final_url, has_ssl and
    robots_blocked.
    """
    verdict = site_facts(T.site_verdict(pages))
    loop = F.col("hops") >= 5
    return verdict.withColumns({
        "probed_state": F.when(loop, "too_many_redirects").otherwise(F.col("site_state")),
        "evidence": F.when(loop, F.array(F.lit("more than 5 redirects"))).otherwise(F.col("evidence")),
        "platform": F.when(~loop, F.col("platform")), "title": F.when(~loop, F.col("title")),
        "has_video": ~loop & F.col("has_video"), "http_status": F.col("status"),
    })


def site_probe_job(leads: DataFrame, pages: DataFrame, socials: DataFrame) -> DataFrame:
    """Site state and facts of every lead from its homepage snapshot (one row per url_key).

    The facts are computed on the page side, so only short columns travel through the join.
    """
    return probe_leads(leads, page_facts(pages).select("url_key", *FACTS), socials)


def probe_leads(leads: DataFrame, facts: DataFrame, socials: DataFrame) -> DataFrame:
    """Leads with the facts of their page; those without a website are settled by their social accounts."""
    social = socials.select(F.col("business_id").alias("id")).distinct().withColumn("_social", F.lit(True))
    df = left_join_known(leads.drop("site_state"), facts, "url_key").join(social, "id", "left")
    no_site = F.when(F.col("_social"), "social_only").otherwise("no_tag")
    has_site = F.col("website_url").isNotNull()
    df = df.withColumn("site_state", F.when(has_site, F.coalesce("probed_state", F.lit("has_tag_unprobed"))).otherwise(no_site))
    return df.withColumns({
        "evidence": F.when(has_site, F.coalesce("evidence", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")),
        "retryable": F.col("site_state").isin("server_error", "timeout"),
        "has_ssl": F.coalesce("has_ssl", F.lit(False)), "has_video": F.coalesce("has_video", F.lit(False)),
    }).drop("_social", "probed_state")


def stage_derive(leads: DataFrame, socials: DataFrame | None = None) -> DataFrame:
    """Enrichment stage after probing (website_url, site_state), after scraping (scraped) and after the follower checks."""
    stage = (
        F.when(F.col("website_url").isNull(), "contacts")
        .when(F.col("site_state").isin("server_error", "timeout"), "probe")
        .when(F.col("site_state") == "too_many_redirects", F.when(F.col("hops") >= 5, "probe").otherwise("socials"))
        .when(F.col("site_state").isin(dims.SCRAPEABLE_STATES), F.when(F.col("scraped"), "contacts").otherwise("scrape"))
        .otherwise("socials")
    )
    df = leads.withColumn("enrichment_stage", stage)
    if socials is None:
        return df
    checks = socials.groupBy(F.col("business_id").alias("id")).agg(
        F.count_if("checked").alias("_checked"), F.count_if(~F.col("checked")).alias("_pending"))
    df = df.join(checks, "id", "left")
    after = F.when(F.col("_checked") > 0, F.when(F.col("_pending") == 0, "socials").otherwise("contacts"))
    return df.withColumn("enrichment_stage", F.coalesce(after, "enrichment_stage")).drop("_checked", "_pending")


def email_state(leads: DataFrame, emails: DataFrame) -> DataFrame:
    """found / none_found for scraped leads, unknown otherwise."""
    some = emails.select(F.col("business_id").alias("id")).distinct().withColumn("_some", F.lit(True))
    state = F.when(~F.col("scraped"), "unknown").when(F.col("_some"), "found").otherwise("none_found")
    return leads.join(some, "id", "left").withColumn("email_state", state).drop("_some")


# --------------------------------------------------------------- extract
def _ranked(source: str, values: Column, ord_: int, confidence: float) -> Column:
    return F.transform(values, lambda v, i: F.struct(
        F.lit(ord_).alias("rank"), i.alias("pos"), F.lit(source).alias("source"), v.alias("value"), F.lit(confidence).alias("confidence")))


def page_parts(pages: DataFrame) -> DataFrame:
    """Adds what all extractions read: visible text, link targets, and the text with spelled-out addresses marked."""
    df = pages.withColumns({"_text": H.body_text(F.col("html")), "_hrefs": H.hrefs(F.col("html"))})
    return df.withColumn("_marked", C.mark_spelled(F.col("_text")))


def email_finds() -> Column:
    """Array of the addresses of a page with their source, over the columns of page_parts."""
    html, text, hrefs = F.col("html"), F.col("_text"), F.col("_hrefs")
    decoded = lambda h: F.coalesce(F.try_url_decode(F.replace(h, F.lit("+"), F.lit("%2B"))), h)
    mailto = F.filter(hrefs, lambda h: h.rlike("(?i)^mailto:"))
    gather = lambda arr: F.flatten(F.transform(arr, C.find_emails))
    protected = F.filter(F.transform(H.attribute_values(html, "data-cfemail"), C.decode_protected), lambda a: a.isNotNull())
    shown = F.filter(F.transform(protected, lambda a: F.lower(F.substring_index(F.trim(a), "?", 1))), C.plausible_email)
    declared = F.transform(H.ld_strings(html, "email"), lambda v: F.regexp_replace(v, "(?i)^mailto:", ""))
    conf = dict(dims.EMAIL_SOURCES)
    return F.concat(
        _ranked("mailto", gather(F.transform(mailto, decoded)), 0, conf["mailto"]), _ranked("jsonld", gather(declared), 1, conf["jsonld"]),
        _ranked("cf-decode", shown, 2, conf["cf-decode"]), _ranked("text", C.find_emails(text), 3, conf["text"]),
        _ranked("text", C.find_repaired(F.col("_marked")), 4, dims.REPAIRED_CONFIDENCE))


def emails_of(finds: DataFrame, key: str) -> DataFrame:
    rows = unnest(finds, [key], F.col("email_finds"), "f").select(key, F.col("f.value").alias("address"), "f.source", "f.confidence", "f.rank", "f.pos")
    best = first_per_key(rows, [key, "address"], [F.col("rank"), F.col("pos")])
    return best.select(key, "address", C.email_kind(F.col("address")).alias("kind"), "source", "confidence")


def email_extract_job(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(page, address, kind, source, confidence) of every page; the most precise source of an address wins.

    One pass over the pages builds a short array of finds; only those are shuffled.
    """
    return emails_of(page_parts(spread(pages)).select(key, email_finds().alias("email_finds")), key)


CHAT_LINK = r"(?i)(?:wa\.me|api\.whatsapp\.com/send\?phone=)/?(\+?\d{6,})"


def phone_finds() -> Column:
    """Array of the number-like strings of a page with their source, over the columns of page_parts."""
    hrefs = F.col("_hrefs")
    tel = F.filter(hrefs, lambda h: h.rlike("(?i)^tel:"))
    chat = F.transform(F.filter(hrefs, lambda h: h.rlike(CHAT_LINK)), lambda h: F.regexp_extract(h, CHAT_LINK, 1))
    written = F.regexp_extract_all(F.col("_text"), F.lit(dims.PHONE_PATTERN), 0)
    conf = dict(dims.PHONE_SOURCES)
    return F.concat(_ranked("tel", tel, 0, conf["tel"]), _ranked("whatsapp", chat, 1, conf["whatsapp"]),
                    _ranked("jsonld", H.ld_strings(F.col("html"), "telephone|phone"), 2, conf["jsonld"]), _ranked("text", written, 3, conf["text"]))


def phones_of(finds: DataFrame, key: str) -> DataFrame:
    rows = unnest(finds, [key, "country_code"], F.col("phone_finds"), "f").withColumn("raw", C.tidy_phone(F.col("f.value")))
    rows = C.add_phone(rows.filter(C.enough_digits(F.col("raw"))), "raw", "country_code")
    rows = rows.select(key, F.coalesce("p.e164", "raw").alias("phone_key"), "raw", "p.e164", "p.is_mobile",
                       (F.col("f.source") == "whatsapp").alias("is_whatsapp"), "f.source", "f.confidence", "p.reject_reason", "f.rank", "f.pos")
    return first_per_key(rows, [key, "phone_key"], [F.col("rank"), F.col("pos")]).drop("rank", "pos", "phone_key")


def phone_extract_job(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(page, raw, e164, is_mobile, is_whatsapp, source, confidence, reject_reason); pages may carry country_code."""
    return phones_of(page_parts(spread(pages)).select(key, country_hint(pages), phone_finds().alias("phone_finds")), key)


def country_hint(pages: DataFrame) -> Column:
    known = "country_code" in pages.columns
    return (F.col("country_code") if known else F.lit(None).cast("string")).alias("country_code")


def social_finds() -> Column:
    """Array of links that may be profiles, over the columns of page_parts."""
    mentions = F.transform(F.regexp_extract_all(F.col("_text"), F.lit(dims.SOCIAL_MENTION), 0), lambda m: F.concat(F.lit("https://"), m))
    found = F.concat(_ranked("link", F.col("_hrefs"), 0, 0.0), _ranked("jsonld", H.ld_same_as(F.col("html")), 1, 0.0), _ranked("text", mentions, 2, 0.0))
    # a cheap host test keeps the many ordinary links out of the URL work
    maybe = "(?i)" + "|".join(h.replace(".", r"\.") for h in [*dims.SOCIAL_HOSTS, *dims.LINK_HUB_HOSTS])
    return F.filter(found, lambda c: c["value"].rlike(maybe))


def socials_of(finds: DataFrame, key: str) -> DataFrame:
    links = unnest(finds, [key], F.col("social_finds"), "f").select(key, "f.value", "f.rank", "f.pos")
    platform = F.when(F.col("n_is_hub"), "linkinbio").otherwise(F.col("n_platform"))
    profile = F.col("n_url").isNotNull() & (F.col("n_is_social") | F.col("n_is_hub")) & ~F.col("n_share")
    rows = keep(U.url_identity(links, "value"), profile, [
        F.col(key), platform.alias("platform"), F.coalesce("n_handle", F.lower("n_url")).alias("account"), F.col("n_url").alias("url"),
        F.col("n_handle").alias("handle"), F.col("rank"), F.col("pos")])
    best = first_per_key(rows, [key, "platform", "account"], [F.col("rank"), F.col("pos")])
    return best.select(key, "platform", "url", "handle")


def social_extract_job(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(page, platform, url, handle) of the profiles a page links to, declares or mentions."""
    return socials_of(page_parts(spread(pages)).select(key, social_finds().alias("social_finds")), key)


def extract_pages(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Facts and finds of every page in one pass; the page text itself is left behind.

    Write the result once and build emails, phones, profiles and verdicts from it: the pages,
    by far the largest input, are then read a single time.
    """
    readable = F.coalesce(F.col("html"), F.lit("")) != ""
    if "content_type" in pages.columns:
        readable = readable & (F.col("content_type").isNull() | F.col("content_type").rlike(HTML_TYPES))
    df = page_parts(page_facts(spread(pages)))
    only = lambda finds: F.when(readable, finds)
    return df.select(
        key, "url_key", "url", "host", *FACTS, country_hint(pages), only(email_finds()).alias("email_finds"),
        only(phone_finds()).alias("phone_finds"), only(social_finds()).alias("social_finds"))


def jsonld_values(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(page, key, value) of email, telephone, phone and sameAs in valid ld+json scripts."""
    html = F.col("html")

    def labelled(name: str):
        return lambda v: F.struct(F.lit(name).alias("key"), v.alias("value"))

    named = [F.transform(H.ld_strings(html, k), labelled(k)) for k in ("email", "telephone", "phone")]
    same = F.transform(H.ld_same_as(html), labelled("sameAs"))
    rows = unnest(pages.filter(html.contains("ld+json")), [key], F.concat(*named, same), "v")
    return rows.select(key, "v.key", "v.value")


# --------------------------------------------------------------- frontier
def contact_link_rank(pages: DataFrame, n: int = 3, key: str = "page_id") -> DataFrame:
    """(page, href, score): same-origin links that look like contact pages, the n best per page.

    Links are taken from the page's html, or from `anchors` where an earlier pass has left them.
    """
    words = "(?i)" + dims.CONTACT_WORDS
    links = F.col("anchors") if "anchors" in pages.columns else H.anchors(F.col("html"))
    rows = U.url_parts(unnest_with_position(pages, [key, "url"], links, "pos", "a"), "url", "b_")
    raw = F.col("a.href")
    origin = F.concat(F.col("b_scheme"), F.lit("://"), F.col("b_host"), F.col("b_port"))
    absolute = (
        F.when(raw == "", None)
        .when(raw.rlike("(?i)^https?://"), raw).when(raw.startswith("//"), F.concat(F.col("b_scheme"), F.lit(":"), raw))
        .when(raw.startswith("/"), F.concat(origin, raw)).when(raw.startswith("?"), F.concat(origin, F.col("b_path"), raw))
        .when(raw.startswith("#"), F.concat(origin, F.col("b_path"), F.col("b_query"))).when(raw.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .otherwise(F.concat(origin, F.regexp_replace("b_path", "[^/]*$", ""), raw))
    )
    rows = U.url_parts(rows.withColumn("abs", absolute), "abs", "l_")
    same_origin = (F.col("b_scheme") == F.col("l_scheme")) & (F.col("b_host") == F.col("l_host")) & (F.col("b_port") == F.col("l_port"))
    page = ~F.col("l_path").rlike("(?i)" + dims.NOT_A_PAGE)
    params = F.filter(F.split(F.regexp_replace("l_query", r"^\?", ""), "&"), lambda p: p != "")
    kept = F.filter(params, lambda p: ~p.rlike("^utm_|^(fbclid|gclid)(=|$)"))
    query = F.when(F.size(kept) == F.size(params), F.col("l_query")).when(F.size(kept) == 0, "").otherwise(F.concat(F.lit("?"), F.array_join(kept, "&")))
    path, text = F.col("l_path"), F.col("a.text")
    depth = F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
    by_path, by_text = path.rlike(words), F.coalesce(text.rlike(words), F.lit(False))
    score = (F.when(by_path, 3).otherwise(0) + F.when(by_text, 2).otherwise(0) + F.greatest(F.lit(0), 2 - depth)
             + F.when(path.rlike("(?i)^/?contact"), 2).otherwise(0))
    href = F.concat(F.col("l_scheme"), F.lit("://"), F.col("l_host"), F.col("l_port"), path, query)
    rows = keep(rows, same_origin & page & (by_path | by_text), [F.col(key), href.alias("href"), score.alias("score"), F.col("pos")])
    best = rows.groupBy(key, "href").agg(F.max("score").alias("score"), F.min("pos").alias("pos"))
    return top_per_key(best, [key], [F.col("score").desc(), F.col("pos")], n).select(key, "href", "score", "pos")


def guessed_urls(sites: DataFrame, key: str = "business_id") -> DataFrame:
    """The four usual contact addresses of a site."""
    origin = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    guesses = F.array(*map(F.lit, dims.CONTACT_GUESSES))
    return sites.filter(origin != "").select(key, F.posexplode(guesses).alias("pos", "g"), origin.alias("o")).select(key, "pos", F.concat("o", "g").alias("url"))


def frontier_union(homepages: DataFrame, ranked: DataFrame, guessed: DataFrame, sitemap: DataFrame | None, key: str = "business_id", budget: int = 4) -> DataFrame:
    """(business, url, ordinal): homepage, ranked links, guesses, sitemap pages that name a contact word; each URL once.

    Links and guesses together are at most `budget`, the sitemap adds at most two, so the
    candidates of one business are few and the later windows over them are small.
    """
    part = lambda df, src: df.select(key, F.lit(src).alias("src"), "pos", "url")
    links = top_per_key(part(ranked, 1).unionByName(part(guessed, 2)), [key], [F.col("src"), F.col("pos")], budget)
    # a position may be a struct: links go by score, then place
    place = links.schema["pos"].dataType
    every = part(homepages.withColumn("pos", F.lit(None).cast(place)), 0).unionByName(links)
    if sitemap is not None:
        named = top_per_key(part(sitemap.filter(F.col("url").rlike("(?i)" + dims.SITEMAP_WORDS)), 3), [key], [F.col("pos")], 2)
        at = F.struct(F.lit(0), "pos").cast(place) if place.typeName() == "struct" else F.col("pos")
        every = every.unionByName(named.withColumn("pos", at))
    once = first_per_key(every, [key, "url"], [F.col("src"), F.col("pos")])
    ordinal = F.row_number().over(Window.partitionBy(key).orderBy("src", "pos")) - 1
    return once.withColumn("ordinal", ordinal).select(key, "url", "ordinal")


def page_budget(candidates: DataFrame, budget: int = 5, key: str = "business_id") -> DataFrame:
    """Candidate pages that are read: in order, until emails, phones and two socials are found or the budget is spent.

    Candidates carry ordinal, n_emails, n_phones and n_socials. Counts only grow, so looking
    at the running sums of the pages before is the same as stopping at the first satisfied one.
    """
    before = Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    df = candidates.filter(F.col("ordinal") < budget)
    df = df.withColumns({"e": so_far("n_emails"), "p": so_far("n_phones"), "s": so_far("n_socials")})
    return df.filter(~((F.col("e") > 0) & (F.col("p") > 0) & (F.col("s") >= 2))).select(*candidates.columns)


# ------------------------------------------------------------- followers
def platform_policy(socials: DataFrame) -> DataFrame:
    """Adds attempt, policy_reason and the state a skipped account gets."""
    policy = dims.dim(socials.sparkSession, "platform_policy").withColumnRenamed("reason", "policy_reason")
    df = socials.join(F.broadcast(policy), "platform", "left")
    skipped = F.when(F.col("policy_reason") == "platform_tos_blocked", "blocked").otherwise("unsupported")
    return df.withColumn("policy_state", F.when(~F.col("attempt"), skipped))


def profile_url(platform: Column, url: Column) -> Column:
    """Facebook profiles are read at /about; all others at their own address."""
    path = F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)
    single = F.size(F.filter(F.split(path, "/"), lambda s: s != "")) == 1
    origin = F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)
    about = F.concat(origin, F.when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/"))), F.lit("about"))
    return F.when((platform == "facebook") & single, about).otherwise(url)


def profile_facts(profiles: DataFrame) -> DataFrame:
    """What is read off saved profile pages (profile_url, html, status, robots_blocked), once per page and platform; the bodies are left behind."""
    wanted = [p for p, (attempt, _) in dims.PLATFORM_POLICY.items() if attempt]
    host_platform = U.social_platform(U.strip_www(F.lower(F.regexp_extract("profile_url", r"^https?://([^/?#]+)", 1))))
    # a page is read for the platform of its host, or for every platform when the host is none of them
    kinds = F.filter(F.array(*map(F.lit, wanted)), lambda p: host_platform.isNull() | (host_platform == p))
    pages = unnest(profiles, ["profile_url", "html", "status", "robots_blocked"], kinds, "platform")
    return C.add_followers(pages, "platform", "html").select(
        "profile_url", "platform", "f", F.col("status").alias("page_status"), F.col("robots_blocked").alias("page_robots"),
        F.col("html").isNotNull().alias("has_page"), F.length("html").cast("bigint").alias("page_chars"))


def follower_snapshot(socials: DataFrame, profiles: DataFrame) -> DataFrame:
    """Accounts with what their saved profile page says (the columns of profile_facts; NULL where none is saved).

    Pages are parsed before the join, so however many accounts name a page, its body is not shuffled.
    """
    due = socials.withColumn("profile_url", profile_url(F.col("platform"), F.col("url")))
    return due.join(profile_facts(profiles), ["profile_url", "platform"], "left")


def follower_check_job(socials: DataFrame, profiles: DataFrame) -> DataFrame:
    """Accounts after a check: overrides kept, policy skips, blocked and failed fetches, else the parsed count."""
    df = follower_snapshot(platform_policy(socials), profiles)
    status = F.col("page_status")
    denied = status.isin(401, 403)
    outcome = (
        F.when(F.col("manual_override").isNotNull(), "kept").when(~F.col("attempt"), "skipped").when(F.col("page_robots"), "robots")
        .when(status == 429, "429").when(~F.coalesce("has_page", F.lit(False)) | status.isNull() | (status >= 400), F.when(denied, "denied").otherwise("failed"))
        .otherwise("ok")
    )
    df = df.withColumn("outcome", outcome)
    pick = lambda kept, skipped, robots, limited, denied_, failed, ok: (
        F.when(F.col("outcome") == "kept", kept).when(F.col("outcome") == "skipped", skipped).when(F.col("outcome") == "robots", robots)
        .when(F.col("outcome") == "429", limited).when(F.col("outcome") == "denied", denied_).when(F.col("outcome") == "failed", failed).otherwise(ok))
    text = lambda v: F.lit(v)
    df = df.withColumns({
        "new_followers": pick(F.col("followers"), *[F.lit(None).cast("bigint")] * 5, F.col("f.followers")),
        "new_state": pick(F.col("followers_state"), F.col("policy_state"), text("unknown"), text("rate_limited"), text("blocked"), text("unknown"), F.col("f.state")),
        "new_reason": pick(F.col("followers_reason"), F.col("policy_reason"), text("robots_disallowed"), text("rate_limited"), text("blocked_by_waf"),
                           text("platform_requires_auth"), F.col("f.reason")),
        "new_video": pick(F.col("has_video"), *[F.lit(False)] * 5, F.col("f.has_video")),
    })
    return df.select(
        *(c for c in socials.columns if c not in ("followers", "followers_state", "followers_reason", "has_video")),
        F.col("new_followers").alias("followers"), F.col("new_state").alias("followers_state"), F.col("new_reason").alias("followers_reason"),
        F.col("new_video").alias("has_video"), "outcome")
