"""Point-of-interest records: response documents to normalised businesses."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import contacts as C
from ..functions import urls as U
from .arrays import keep, unnest, unnest_with_position
from .ordered import first_per_key, insert_new

ELEMENT = ("struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,"
           "tags:map<string,string>>")


def triage(df: DataFrame) -> DataFrame:
    """Adds ok, failure_kind and n (elements) to stored responses (body, status)."""
    body, status = F.col("body"), F.col("status")
    json = F.try_parse_json(body)
    n = F.size(F.try_variant_get(json, "$.elements", "array<variant>"))
    remark = F.coalesce(F.try_variant_get(json, "$.remark", "string"), F.lit(""))
    by_status = F.when(status >= 500, "unavailable").when(status >= 400, "bad_request").otherwise("ok")
    page = (
        F.when(body.rlike("(?i)" + dims.ENGINE_ERROR_PAGE) & body.rlike("(?i)" + dims.QUERY_TOO_HEAVY), "server_timeout")
        .when(status.between(400, 499), "bad_request").otherwise("unavailable")
    )
    kind = (
        F.when(F.coalesce(body, F.lit("")).rlike(r"^\s*$"), "unavailable")
        .when(body.rlike(r"^\s*<"), page)
        .when(json.isNull() | n.isNull() | (n < 0), "bad_request")
        .when(remark.rlike("(?i)" + dims.FATAL_REMARK), "server_timeout")
        .otherwise(by_status)
    )
    return df.withColumns({"failure_kind": kind, "n": F.when(n >= 0, n).otherwise(0).cast("bigint")}).withColumn(
        "ok", F.col("failure_kind") == "ok")


def elements(df: DataFrame) -> DataFrame:
    """One row per element of the response documents in `body`, with the data date."""
    doc = F.from_json("body", f"elements array<{ELEMENT}>, osm3s map<string,string>")
    parsed = df.select(doc.alias("d"))
    osm_base = F.try_element_at("d.osm3s", F.lit("timestamp_osm_base")).alias("osm_base")
    rows = unnest(parsed, [osm_base], F.col("d.elements"), "e")
    return rows.select("e.*", "osm_base").withColumn("tags", F.coalesce("tags", F.create_map().cast("map<string,string>")))


def tag(name: str) -> Column:
    return F.try_element_at(F.col("tags"), F.lit(name))


def blank_to_null(col: Column) -> Column:
    return F.nullif(F.trim(col), F.lit(""))


def first_tag(keys: list[str]) -> Column:
    return F.coalesce(*(blank_to_null(tag(k)) for k in keys))


def multi_value(col: Column) -> Column:
    parts = F.filter(F.transform(F.split(col, ";"), lambda v: F.trim(v)), lambda v: v != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def named(pois: DataFrame) -> DataFrame:
    return pois.filter(F.coalesce(F.trim(tag("name")), F.lit("")) != "")


def alive(pois: DataFrame) -> DataFrame:
    prefix = "^(?:" + "|".join(dims.DEAD_TAG_PREFIXES) + ")"
    dead_prefix = F.exists(F.map_keys("tags"), lambda k: k.rlike(prefix))
    dead_key = F.lit(False)
    for key in dims.DEAD_TAG_KEYS:
        dead_key = dead_key | F.coalesce(~F.trim(tag(key)).rlike("(?i)^(no|false|0)$"), F.lit(False))
    lifecycle = F.coalesce(tag("lifecycle").rlike("(?i)" + dims.DEAD_LIFECYCLE), F.lit(False))
    return pois.filter(~(dead_prefix | dead_key | lifecycle))


def located(pois: DataFrame) -> DataFrame:
    return pois.withColumns({"lat": F.coalesce("lat", "center.lat"), "lon": F.coalesce("lon", "center.lon")})


def osm_key() -> Column:
    return F.concat_ws("/", "type", F.col("id").cast("string"))


def contacts() -> dict[str, Column]:
    gather = lambda keys: F.array_distinct(F.concat(*(multi_value(tag(k)) for k in keys)))
    return {"phones": gather(dims.PHONE_TAGS), "emails": gather(dims.EMAIL_TAGS)}


def website() -> Column:
    return F.get(multi_value(first_tag(dims.WEBSITE_TAGS)), F.lit(0))


def social_values() -> Column:
    """Array of (platform, raw) from the social tags; the tag decides the platform."""

    def labelled(platform: str):
        return lambda v: F.struct(F.lit(platform).alias("platform"), v.alias("raw"))

    return F.concat(*(F.transform(multi_value(first_tag(keys)), labelled(platform)) for keys, platform in dims.SOCIAL_TAGS))


def socials(pois: DataFrame) -> DataFrame:
    """(osm_key, platform, url, handle) of every social tag value that is a web address."""
    rows = unnest(pois, [osm_key().alias("osm_key")], social_values(), "s")
    rows = U.url_identity(rows.select("osm_key", "s.platform", "s.raw"), "raw")
    return keep(rows, F.col("n_url").isNotNull(), [
        F.col("osm_key"), F.col("platform"), F.col("n_url").alias("url"), F.col("n_handle").alias("handle")])


def category() -> dict[str, Column]:
    """Category key and label of the first selector that matches, in one projection."""
    out_key = out_label = None
    for cat, label, sels in dims.CATEGORIES:
        for key, values in sels:
            hit = F.trim(F.substring_index(tag(key), ";", 1)).isin(values)
            out_key = F.when(hit, cat) if out_key is None else out_key.when(hit, cat)
            out_label = F.when(hit, label) if out_label is None else out_label.when(hit, label)
    return {"category": out_key.otherwise("other"), "category_label": out_label.otherwise("Other")}


def address() -> dict[str, Column]:
    street, number = blank_to_null(tag("addr:street")), blank_to_null(tag("addr:housenumber"))
    return {
        "street": street,
        "house_number": number,
        "address_line": F.coalesce(blank_to_null(F.concat_ws(" ", number, street)), blank_to_null(tag("addr:full"))),
        "city": F.coalesce(*(blank_to_null(tag("addr:" + k)) for k in ("city", "town", "village"))),
        "postcode": blank_to_null(tag("addr:postcode")),
        "state": blank_to_null(tag("addr:state")),
        "country_code": F.lower(F.trim(tag("addr:country"))),
    }


def normalize(pois: DataFrame) -> DataFrame:
    """Named, living POIs with every derived column of a new business. Map-side only."""
    df = located(alive(named(pois)))
    df = df.withColumns({"osm_key": osm_key(), "name": F.trim(tag("name")), "website": website(), **contacts(),
                         **category(), **address()})
    df = df.withColumn("name_normalized", U.normalize_name(F.col("name")))
    df = U.url_identity(df, "website")
    real_site = F.coalesce(F.col("n_url").isNotNull() & ~F.col("n_is_social") & ~F.col("n_is_hub"), F.lit(False))
    social = F.coalesce(F.col("n_url").isNotNull() & F.col("n_is_social"), F.lit(False))
    any_social_tag = F.exists(social_values(), lambda s: U.strip_www(F.regexp_extract(
        F.when(s["raw"].rlike("(?i)^https?://"), s["raw"]).otherwise(F.concat(F.lit("https://"), s["raw"])),
        r"(?i)^https?://([^/?#\s%<>\[\]^|:]+)(?:[:/?#].*)?$", 1)).contains("."))
    return df.withColumns({
        "site_state": F.when(real_site, "has_tag_unprobed").when(social | any_social_tag, "social_only").otherwise("no_tag"),
        "website_url": F.when(real_site, F.col("n_url")),
        "website_domain": F.when(real_site, F.col("n_domain")),
        "dedupe_key": F.coalesce("n_dedupe_key", "address_line", "name_normalized"),
        "phone_raw": F.get("phones", F.lit(0)),
    })


def category_scope(categories: list[str]) -> list[str]:
    """Requested category keys; everything when none is asked for or recognised."""
    known = [c[0] for c in dims.CATEGORIES]
    picked = [c for c in known if c in set(categories)]
    return known if not picked or "all" in categories else picked


def scoped_categories(selectors: DataFrame, categories: list[str]) -> DataFrame:
    return selectors.filter(F.col("category").isin(category_scope(categories)))


def merged_selectors(selectors: DataFrame) -> DataFrame:
    """Distinct values per tag key, in the order they first appear."""
    firsts = selectors.groupBy("tag_key", "tag_value").agg(F.min(F.struct("cat_ord", "sel_ord", "pos")).alias("at"))
    merged = firsts.groupBy("tag_key").agg(F.sort_array(F.collect_list(F.struct("at", "tag_value"))).alias("v"))
    return merged.select(F.col("tag_key"), F.transform("v", lambda x: x["tag_value"]).alias("tag_values"))


def scan(pois: DataFrame, categories: list[str], bbox: tuple[float, float, float, float], keyword: str | None = None,
         ) -> DataFrame:
    """All POIs of a category scope inside a box (south, west, north, east)."""
    values: dict[str, set[str]] = {}
    scope = category_scope(categories)
    for cat, _, sels in dims.CATEGORIES:
        for key, names in sels if cat in scope else []:
            values.setdefault(key, set()).update(names)
    hit = F.lit(False)
    for key, names in values.items():
        hit = hit | F.coalesce(tag(key).isin(sorted(names)), F.lit(False))
    south, west, north, east = bbox
    df = located(pois).filter(hit & tag("name").isNotNull())
    df = df.filter(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    if keyword and keyword.strip():
        df = df.filter(tag("name").rlike("(?i)" + keyword.strip().replace('"', "").replace("\\", "")))
    return df.withColumn("osm_key", osm_key())


# ------------------------------------------------------------- upserts
TAKE_NEW = ["name", "name_normalized", "category", "category_label", "tags"]
NEW_IF_GIVEN = ["lat", "lon", "country_code", "address_line", "city", "postcode", "state"]
KEEP_OLD = ["osm_type", "street", "house_number", "phone_raw", "website_url", "website_domain", "dedupe_key", "site_state",
            "pipeline_stage"]


def last_seen(pois: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """One row per osm_key: the last in the given order, such as document and position. Without an order any one, but always the same."""
    rest = [c for c in pois.columns if c != "osm_key"]
    row = F.struct(*rest)
    best = pois.groupBy("osm_key").agg(F.max_by(row, F.struct(*(order or []), F.xxhash64(F.to_json(row)))).alias("_row"))
    return best.select("osm_key", *(F.col(f"_row.{c}").alias(c) for c in rest)).select(*pois.columns)


def upsert(old: DataFrame, new: DataFrame, now: str, order: list[Column] | None = None) -> DataFrame:
    """New snapshot of the business table from the old one and normalised POIs, with is_new.

    A POI given several times (overlapping tiles, repeated runs) counts once, as last seen by `order`.

    A full outer join on osm_key; each column says whether the new value, the new value
    if there is one, or the old value wins. Columns missing on a side count as NULL.
    """
    new = last_seen(new, order)
    o, n = old.alias("o"), new.alias("n")
    have = lambda side, frame, c: F.col(f"{side}.{c}") if c in frame.columns else F.lit(None)
    was_there, comes = F.col("o.osm_key").isNotNull(), F.col("n.osm_key").isNotNull()
    stamp = F.lit(now).cast("timestamp")
    wanted = lambda cs: [c for c in cs if c in old.columns or c in new.columns]
    columns = {c: F.when(comes, have("n", new, c)).otherwise(have("o", old, c)) for c in wanted(TAKE_NEW)}
    columns |= {c: F.coalesce(have("n", new, c), have("o", old, c)) for c in wanted(NEW_IF_GIVEN)}
    columns |= {c: F.when(was_there, have("o", old, c)).otherwise(have("n", new, c)) for c in wanted(KEEP_OLD)}
    columns |= {
        "first_seen_at": F.when(was_there, have("o", old, "first_seen_at")).otherwise(stamp),
        "last_seen_at": F.when(comes, stamp).otherwise(have("o", old, "last_seen_at")),
        "is_new": ~was_there,
    }
    joined = o.join(n, F.col("o.osm_key") == F.col("n.osm_key"), "full_outer")
    return joined.select(F.coalesce("o.osm_key", "n.osm_key").alias("osm_key"), *(c.alias(k) for k, c in columns.items()))


def add_tag_phones(pois: DataFrame) -> DataFrame:
    """One row per entry of `phones` with (ord, raw, e164, is_mobile, confidence, reject_reason); the other columns stay."""
    rest = [c for c in pois.columns if c != "phones"]
    rows = C.add_phone(unnest_with_position(pois, rest, F.col("phones"), "ord", "raw"), "raw", "country_code")
    return rows.select(*rest, "ord", "raw", "p.e164", "p.is_mobile",
                       F.when(F.col("p.e164").isNotNull(), 70).otherwise(50).cast("bigint").alias("confidence"), "p.reject_reason")


def add_tag_emails(pois: DataFrame) -> DataFrame:
    """One row per entry of `emails` with (ord, address, domain, kind, confidence); the other columns stay."""
    rest = [c for c in pois.columns if c != "emails"]
    rows = unnest_with_position(pois, rest, F.col("emails"), "ord", "raw")
    return rows.select(*rest, "ord", F.lower("raw").alias("address"), F.lower(F.get(F.split("raw", "@"), F.lit(1))).alias("domain"),
                       F.lit("role").alias("kind"), F.lit(60).cast("bigint").alias("confidence"))


def poi_phones(pois: DataFrame) -> DataFrame:
    """(osm_key, ord, raw, e164, is_mobile, confidence, reject_reason) of the phone tags."""
    return add_tag_phones(pois.select("osm_key", "country_code", "phones")).drop("country_code")


def insert_phones(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Adds phones not yet known: by number where it is resolved, else by the raw text."""
    keyed = lambda df: df.withColumn("phone_key", F.coalesce("e164", "raw"))
    return insert_new(keyed(existing), keyed(incoming), ["osm_key", "phone_key"], [F.col("ord")]).drop("phone_key")


def poi_emails(pois: DataFrame) -> DataFrame:
    return add_tag_emails(pois.select("osm_key", "emails"))


def insert_emails(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return insert_new(existing, incoming, ["osm_key", "address"], [F.col("ord")])


def all_socials(pois: DataFrame) -> DataFrame:
    """Social tags plus a social address given as the website, as (osm_key, platform, url, handle)."""
    as_site = keep(pois, F.col("n_url").isNotNull() & F.col("n_platform").isNotNull(), [
        F.col("osm_key"), F.col("n_platform").alias("platform"), F.col("n_url").alias("url"), F.col("n_handle").alias("handle")])
    return socials(pois).unionByName(as_site)


def upsert_socials(old: DataFrame, new: DataFrame, key: str = "osm_key", order: list[Column] | None = None) -> DataFrame:
    """Old accounts with the URL overwritten and a missing handle filled; unseen accounts added.

    The account key is (business, platform, handle or lower-cased URL). Follower columns stay.
    """
    keys = [key, "platform", "handle_normalized"]
    # the last row by `order` gives both values; without an order the greatest
    account = F.struct("url", "handle")
    fresh = new.withColumn("handle_normalized", F.coalesce("handle", F.lower("url"))).groupBy(*keys).agg(
        F.max_by(account, F.struct(*(order or []), account)).alias("_last"))
    fresh = fresh.select(*keys, F.col("_last.url").alias("new_url"), F.col("_last.handle").alias("new_handle"))
    joined = old.join(fresh, keys, "full_outer")
    rest = [c for c in old.columns if c not in [*keys, "url", "handle", "followers_state"]]
    return joined.select(
        *keys, F.coalesce("new_url", "url").alias("url"), F.coalesce("new_handle", "handle").alias("handle"),
        F.coalesce("followers_state", F.lit("not_attempted")).alias("followers_state"), *rest)


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """A POI returned by several tiles counts once: its earliest hit."""
    return first_per_key(hits, ["osm_key"], [F.col("hit_id")])


def run_poi_links(hits: DataFrame) -> DataFrame:
    """Distinct businesses per run."""
    return hits.select("query_id", "osm_key").distinct().groupBy("query_id").agg(F.count("*").alias("n"))
