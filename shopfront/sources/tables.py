"""Readers and writers: POI documents, page snapshots, activity logs, places, and the CSV export."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import urls as U
from ..operators import poi
from ..operators.arrays import keep
from ..operators.ordered import first_per_key

PAGE_SCHEMA = "page_id bigint, url string, html string, status int, content_type string, fetched_at timestamp"
ACTIVITY_SCHEMA = "id bigint, kind string, business_id bigint, at timestamp, day date, meta string"


def read_pois(spark: SparkSession, path: str) -> DataFrame:
    """Elements of response documents saved one per file, or one per line with a .jsonl name."""
    if path.endswith(".jsonl"):
        docs = spark.read.text(path)
    else:
        docs = spark.read.text(path, wholetext=True)
    return poi.elements(docs.withColumnRenamed("value", "body"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved pages of an HTML type."""
    return html_pages(spark.read.schema(PAGE_SCHEMA).parquet(path))


def html_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(F.col("content_type").isNull() | F.col("content_type").rlike("(?i)text/html|application/xhtml"))


def read_activity(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(ACTIVITY_SCHEMA).parquet(path)


def fresh_pages(fetches: DataFrame, now: str, error_ttl: int = 3600) -> DataFrame:
    """Latest fetch of every cache key, if it is ok and has not expired.

    An error entry lives at most an hour. Only key and times are compared before the choice.
    """
    fetched = F.col("fetched_at").cast("timestamp")
    keyed = U.cache_key(fetches, "url", "url_key")
    keyed = keep(keyed, F.col("url_key").isNotNull(), [F.col(c) for c in keyed.columns])
    ok = F.coalesce(F.col("status").between(200, 399), F.lit(False))
    ttl = F.when(ok, F.col("ttl_seconds")).otherwise(F.least(F.col("ttl_seconds"), F.lit(error_ttl)))
    keyed = keyed.withColumns({"fetch_ok": ok, "expires_at": F.timestamp_seconds(F.unix_seconds(fetched) + ttl)})
    latest = first_per_key(keyed, ["url_key"], [-F.unix_micros(fetched), -F.col("id")])
    return latest.filter(F.col("fetch_ok") & (F.col("expires_at") > F.lit(now).cast("timestamp")))


def page_body(meta: DataFrame, bodies: DataFrame) -> DataFrame:
    """Page metadata with its body; filter the metadata first, bodies are large."""
    return meta.join(bodies, "url_key", "left")


def location_key(col: Column) -> Column:
    return F.regexp_replace(F.lower(U.strip(col)), r"\s+", " ")


def geocode_join(requests: DataFrame, places: DataFrame) -> DataFrame:
    """Location texts with the place they name: box as south, west, north, east; area id for relations."""
    known = places.filter("fetch_state = 'ok'").select(
        "location_key", "display_name", "country_code", F.col("b0").alias("south"), F.col("b2").alias("west"), F.col("b1").alias("north"),
        F.col("b3").alias("east"), F.when(F.col("osm_type") == "relation", F.col("osm_id") + dims.RELATION_AREA_BASE).alias("area_id"))
    return requests.withColumn("location_key", location_key(F.col("location_text"))).join(known, "location_key", "left")


# ------------------------------------------------------------------ export
def csv_cell(col: Column) -> Column:
    text = F.coalesce(col.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\n\r]'), quoted).otherwise(text)


def platforms_of(socials: DataFrame) -> DataFrame:
    """Platform words of each lead, one per account, in platform order. Counted before they are joined: at most 12 entries."""
    counts = socials.groupBy("business_id", "platform").agg(F.count("*").alias("n"))
    word = F.trim(F.repeat(F.concat(F.col("platform"), F.lit(" ")), F.col("n").cast("int")))
    listed = counts.groupBy(F.col("business_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("platform", word.alias("w")))).alias("p"))
    return listed.select("id", F.concat_ws(" ", F.transform("p", lambda p: p["w"])).alias("platforms"))


def csv_rows(leads: DataFrame, socials: DataFrame) -> DataFrame:
    """The 13 export columns as quoted cells plus the finished line."""
    from ..functions.score import lookup

    df = leads.join(platforms_of(socials), "id", "left")
    cells = [
        F.col("name"), F.coalesce("category_label", "category"), F.col("score"),
        lookup(F.col("site_state"), dims.SITE_STATE_LABELS, F.col("site_state")), F.col("website_url"), F.col("email"),
        F.coalesce("phone_e164", "phone_raw"), F.col("followers_total"), F.col("platforms"), F.col("city"), F.upper("country_code"),
        F.col("pipeline_stage"), F.date_format("first_seen_at", "yyyy-MM-dd"),
    ]
    return df.withColumn("line", F.concat_ws(",", *map(csv_cell, cells)))


def write_leads_csv(leads: DataFrame, socials: DataFrame, path: str, sort: str = "score") -> None:
    """Writes the export in feed order, CRLF line ends; the first line carries the byte-order mark.

    Sorted part files in order make up the whole export, so no single task writes it all.
    """
    from ..operators.leads import feed_order

    spark = leads.sparkSession
    lines = csv_rows(leads, socials).orderBy(*feed_order(sort)).select(F.col("line").alias("value"))
    header = spark.range(1).select(F.lit("﻿" + ",".join(dims.CSV_HEADER)).alias("value"))
    header.write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/part=0_header")
    lines.write.mode("overwrite").option("lineSep", "\r\n").text(f"{path}/part=1_rows")
