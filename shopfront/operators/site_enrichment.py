"""Site enrichment as one job over saved pages: probe, follow each site's pages until it is satisfied, extract, score.

Page bodies are read once: one pass leaves facts, finds and possible contact links of every page in a narrow table.
The frontier is then worked off in rounds. A round takes only the pages that its sites reach newly, meets them with the
narrow table by the hash of their cache key, and writes what they hold; sites that have an address, a valid phone and two
profiles leave, and so do sites without further candidates. No site is ever gathered in one task, and each round
only carries one small row per open site.

Candidates of a site, in order: the homepage, its best contact links, the usual contact addresses, and two sitemap pages
that name a contact word, if its robots file names a sitemap. Each address is visited once and at most `budget` besides the homepage.
A page that is not saved, not readable or closed by robots rules counts as visited and gives nothing.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import html as H
from ..functions import urls as U
from . import enrichment as E
from . import leads as L
from . import robots as R
from .arrays import keep
from .ordered import first_per_key, insert_new, left_join_known
from .workspace import Workspace

#: Room for the visits of one site in the number of a visit: 6 bits.
VISITS = 64
FINDS = ["email_finds", "phone_finds", "social_finds"]


def contact_anchors() -> Column:
    """Links of a page that may be contact pages: a contact word in address or text, or anywhere in the page's own address."""
    words = "(?i)" + dims.CONTACT_WORDS
    return F.when(F.col("url").rlike(words), H.anchors(F.col("html"))).otherwise(
        F.filter(H.anchors(F.col("html")), lambda a: a["href"].rlike(words) | a["text"].rlike(words)))


def site_pages(pages: DataFrame) -> DataFrame:
    """One short row per cache key, as last fetched: facts, finds and contact anchors. The only pass over page bodies."""
    readable = F.coalesce(F.col("html"), F.lit("")) != ""
    readable = readable & (F.col("content_type").isNull() | F.col("content_type").rlike(E.HTML_TYPES)) & F.coalesce(F.col("status").between(200, 299), F.lit(False)) & ~F.col("robots_blocked")
    df = E.page_parts(E.page_facts(U.cache_key(pages.drop("url_key"), "url", "url_key")))
    only = lambda finds: F.when(readable, finds)
    narrow = df.select("url_key", "page_id", "url", *E.FACTS, "hops", "fetched_at", only(E.email_finds()).alias("email_finds"),
                       only(E.phone_finds()).alias("phone_finds"), only(E.social_finds()).alias("social_finds"), only(contact_anchors()).alias("anchors"))
    keyed = keep(narrow, F.col("url_key").isNotNull(), [F.col(c) for c in narrow.columns])
    return first_per_key(keyed, ["url_key"], [-F.unix_micros(F.col("fetched_at").cast("timestamp")), -F.col("page_id")])


def allowed_urls(candidates: DataFrame, robots: DataFrame | None, token: str) -> DataFrame:
    """Candidates (business_id, url, ordinal) with url_key and allowed."""
    df = U.cache_key(candidates, "url", "url_key")
    if robots is None:
        return df.withColumn("allowed", F.lit(True))
    domain = U.strip_www(F.lower(F.regexp_extract("url", r"^https?://([^/?#:]+)", 1)))
    asked = df.withColumns({"domain": domain, "path": F.regexp_extract("url", "^https?://[^/?#]+([^#]*)", 1)})
    decided = R.frontier_robots(asked, robots.withColumn("domain", U.strip_www(F.lower("domain"))), token)
    return decided.select(*df.columns, "allowed")


def sitemap_pages(sites: DataFrame, robots: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """(business_id, pos, url) of the sitemap that a site's robots file names first."""
    files = R.robots_state(robots).filter("state = 'ok'").withColumn("domain", U.strip_www(F.lower("domain")))
    named = R.robots_rules(files).filter("kind = 'sitemap'").groupBy("domain").agg(F.min_by("value", "line").alias("sitemap_url"))
    own = sites.select("business_id", U.strip_www(F.lower(F.regexp_extract("url", r"^https?://([^/?#:]+)", 1))).alias("domain"))
    found = own.join(named, "domain").join(sitemaps.select(F.col("url").alias("sitemap_url"), "xml"), "sitemap_url")
    return found.select("business_id", F.posexplode(R.sitemap_urls(F.col("xml"))).alias("pos", "url"))


def visited(frontier: DataFrame, facts: DataFrame) -> DataFrame:
    """What the pages of a frontier hold; those that are not saved or not allowed hold nothing."""
    keyed = frontier.withColumn("url_key", F.when(F.col("allowed"), F.col("url_key")))
    got = left_join_known(keyed.withColumnRenamed("url", "asked_url"), facts.select("url_key", "page_id", F.coalesce("final_url", "url").alias("url"), *FINDS, "anchors"), "url_key")
    return got.withColumn("visit", F.col("business_id") * VISITS + F.col("ordinal"))


def found_counts(got: DataFrame) -> DataFrame:
    """(business_id, e, p, s): addresses, valid phones and profiles of the visited pages, counted per page."""
    phones = E.phones_of(got, "visit").groupBy("visit").agg(F.count("e164").alias("p"))
    socials = E.socials_of(got, "visit").groupBy("visit").agg(F.count("*").alias("s"))
    addresses = F.coalesce(F.size(F.array_distinct(F.transform("email_finds", lambda f: f["value"]))), F.lit(0))
    rows = got.select("visit", "business_id", addresses.alias("e")).join(phones, "visit", "left").join(socials, "visit", "left")
    return rows.groupBy("business_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("e", "p", "s")))


def still_open(sites: DataFrame, got: DataFrame) -> DataFrame:
    """The open sites with the counts of a round added, without those that are satisfied."""
    more = found_counts(got).select("business_id", *(F.col(c).alias("more_" + c) for c in ("e", "p", "s")))
    zero = F.lit(0)
    df = sites.join(more, "business_id", "left")
    df = df.withColumns({c: F.col(c) + F.coalesce("more_" + c, zero) for c in ("e", "p", "s")}).select(*sites.columns)
    return df.filter(~((F.col("e") > 0) & (F.col("p") > 0) & (F.col("s") >= 2)))


def enrich_sites(leads: DataFrame, pages: DataFrame, *, emails: DataFrame, phones: DataFrame, socials: DataFrame, robots: DataFrame | None = None,
                 sitemaps: DataFrame | None = None, profiles: DataFrame | None = None, budget: int = 4, token: str = "shopfrontbot") -> dict[str, DataFrame]:
    """The leads after probing, scraping, follower checks and scoring, with their contacts and the visits made.

    leads: id, name, website_url, country_code. pages: saved snapshots with what a probe sees, any number per address.
    emails, phones and socials are known already and keep their place: a found one that is known changes nothing,
    except that an account takes the address it was found with last. profiles: saved profile pages for the follower check.

    Returns leads, emails, phones, socials and visits, written; the steps between are taken away.
    """
    if budget + 3 >= VISITS:
        raise ValueError(f"a budget below {VISITS - 3}")
    spark = leads.sparkSession
    steps, out = Workspace(spark, "site-steps"), Workspace(spark, "site-enrichment")
    facts = steps.written(site_pages(pages), "pages")
    keyed = U.cache_key(leads.drop("url_key"), "website_url", "url_key")
    probed = steps.written(E.probe_leads(keyed, facts.select("url_key", "hops", *E.FACTS), socials), "probed")
    scraped = F.col("website_url").isNotNull() & F.col("site_state").isin(dims.SCRAPEABLE_STATES)
    homes = probed.filter(scraped).select(F.col("id").alias("business_id"), F.coalesce("final_url", "website_url").alias("url"), "country_code")
    none = F.lit(0).cast("bigint")
    sites = homes.select("business_id", "country_code", *(none.alias(c) for c in ("e", "p", "s")))

    first = allowed_urls(homes.select("business_id", "url", F.lit(0).alias("ordinal"), "country_code"), robots, token)
    rounds = [steps.written(visited(first, facts), "round-0")]
    sites = steps.written(still_open(sites, rounds[0]), "open-0")

    # every further candidate is known from the homepage
    begun = homes.join(sites.select("business_id"), "business_id", "left_semi").select("business_id", "url")
    bases = rounds[0].filter(F.size("anchors") > 0).join(sites.select("business_id"), "business_id", "left_semi")
    ranked = E.contact_link_rank(bases.select("business_id", "url", "anchors"), budget, "business_id").select("business_id", "pos", "score", F.col("href").alias("url"))
    by_score = ranked.select("business_id", F.struct((-F.col("score")).alias("score"), F.col("pos")).alias("pos"), "url")
    guessed = E.guessed_urls(begun).select("business_id", F.struct(F.lit(0).alias("score"), F.col("pos")).alias("pos"), "url")
    maps = sitemap_pages(begun, robots, sitemaps) if robots is not None and sitemaps is not None else None
    every = E.frontier_union(begun, by_score, guessed, maps, budget=budget)
    candidates = steps.written(allowed_urls(every.filter(F.col("ordinal").between(1, budget)), robots, token), "candidates")

    for ordinal in range(1, budget + 1):
        reached = candidates.filter(F.col("ordinal") == ordinal).join(sites.select("business_id", "country_code"), "business_id")
        got = steps.written(visited(reached.select(*first.columns), facts), f"round-{ordinal}")
        if got.isEmpty():
            break
        rounds.append(got)
        if ordinal < budget:
            sites = steps.written(still_open(sites, got), f"open-{ordinal}")

    got = rounds[0]
    for more in rounds[1:]:
        got = got.unionByName(more)
    tables = {"emails": known_first(emails, site_emails(got), [F.col("address")]),
              "phones": known_first(phones, site_phones(got), [F.coalesce("e164", "raw")]), "socials": known_socials(socials, site_socials(got))}
    tables = {name: out.written(df, name) for name, df in tables.items()}
    if profiles is not None:
        checked = E.follower_check_job(tables["socials"], profiles)
        tables["socials"] = out.written(checked.drop("outcome"), "checked-socials")
    after = E.stage_derive(probed.withColumn("scraped", scraped))
    after = L.scored(L.denorm(E.email_state(after, tables["emails"]), tables["phones"], tables["emails"], tables["socials"]))
    tables["leads"] = out.written(after.drop("url_key"), "leads")
    tables["visits"] = out.written(got.select("business_id", "ordinal", F.col("asked_url").alias("url"), "allowed", "page_id"), "visits")
    steps.drop()
    return tables


# ------------------------------------------------------------------ contacts
def per_business(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"business_id": F.shiftright("visit", 6), "ordinal": F.col("visit").bitwiseAND(VISITS - 1)})


def percent() -> Column:
    return F.round(F.col("confidence") * 100).cast("bigint").alias("confidence")


def site_emails(got: DataFrame) -> DataFrame:
    """Addresses per site, as found on the first page that has them."""
    rows = per_business(E.emails_of(got, "visit"))
    return first_per_key(rows, ["business_id", "address"], [F.col("ordinal")]).select(
        F.xxhash64("business_id", "address").alias("id"), "business_id", "address", "kind", percent(), F.lit("site").alias("source"), "ordinal")


def site_phones(got: DataFrame) -> DataFrame:
    """Phones per site; a number that cannot be resolved is known by its text."""
    rows = per_business(E.phones_of(got, "visit")).withColumn("phone_key", F.coalesce("e164", "raw"))
    return first_per_key(rows, ["business_id", "phone_key"], [F.col("ordinal")]).select(
        F.xxhash64("business_id", "phone_key").alias("id"), "business_id", "raw", "e164", percent(), F.lit("site").alias("source"), "ordinal")


def site_socials(got: DataFrame) -> DataFrame:
    rows = per_business(E.socials_of(got, "visit")).withColumn("handle_normalized", F.coalesce("handle", F.lower("url")))
    last = F.max_by(F.struct("url", "handle"), "ordinal").alias("v")
    return rows.groupBy("business_id", "platform", "handle_normalized").agg(last).select(
        F.xxhash64("business_id", "platform", "handle_normalized").alias("id"), "business_id", "platform", "handle_normalized", "v.url", "v.handle")


def known_first(known: DataFrame, found: DataFrame, key: list) -> DataFrame:
    """What is known, as it is, and what is found beyond it."""
    columns = [c for c in found.columns if c != "ordinal"]
    keyed = lambda df, ordinal: df.select(*columns, ordinal.cast("bigint").alias("ordinal"), *(k.alias(f"key_{i}") for i, k in enumerate(key)))
    keys = ["business_id", *(f"key_{i}" for i in range(len(key)))]
    return insert_new(keyed(known, F.lit(-1)), keyed(found, F.col("ordinal")), keys, [F.col("ordinal")]).select(*columns)


def known_socials(socials: DataFrame, found: DataFrame) -> DataFrame:
    """Known accounts with the address they were found with, and the new ones, not yet checked."""
    keys = ["business_id", "platform", "handle_normalized"]
    new = found.select(*keys, F.col("id").alias("new_id"), F.col("url").alias("new_url"), F.col("handle").alias("new_handle"))
    df = socials.join(new, keys, "full_outer")
    rest = [c for c in socials.columns if c not in [*keys, "id", "url", "handle", "followers_state", "has_video"]]
    return df.select(F.coalesce("id", "new_id").alias("id"), *keys, F.coalesce("new_url", "url").alias("url"), F.coalesce("new_handle", "handle").alias("handle"),
                     F.coalesce("followers_state", F.lit("not_attempted")).alias("followers_state"), F.coalesce("has_video", F.lit(False)).alias("has_video"), *rest)
