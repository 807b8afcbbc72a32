"""Discovery as one job: saved response documents to businesses, contacts, accounts and ranked leads.

Documents are triaged and parsed once; the short POI rows are written and everything else starts from them. Businesses, contacts
and leads are snapshots cut alike by the hash of the business key, so a batch reads and rewrites, of every table, only the
folders its own keys fall into. Running a batch again changes nothing but the times it stamps, and those not either if
`now` is the same.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from . import leads as L
from . import poi as P
from .arrays import unnest_with_position
from .ordered import insert_new
from .snapshot import Snapshot
from .workspace import Workspace

AT = "struct<batch:timestamp,doc_id:bigint,pos:int,ord:int>"
SCHEMAS = {
    "businesses": "osm_key string, name string, name_normalized string, category string, category_label string, tags map<string,string>, lat double, lon double,"
                  " country_code string, address_line string, city string, postcode string, state string, street string, house_number string, phone_raw string,"
                  " website_url string, website_domain string, dedupe_key string, site_state string, first_seen_at timestamp, last_seen_at timestamp",
    "phones": f"osm_key string, phone_key string, raw string, e164 string, is_mobile boolean, confidence bigint, reject_reason string, id {AT}",
    "emails": f"osm_key string, address string, domain string, kind string, confidence bigint, id {AT}",
    "socials": "osm_key string, platform string, handle_normalized string, url string, handle string, followers_state string, followers bigint,"
               " manual_override bigint, has_video boolean",
    "links": "osm_key string, query_id bigint, found_at timestamp",
    "leads": "osm_key string, name string, category string, site_state string, website_url string, dedupe_key string, name_normalized string, address_line string, lat double, lon double, has_phone boolean, has_email boolean, has_social boolean,"
             " has_website boolean, email string, phone_e164 string, phone_raw string, followers_total bigint, score bigint, first_seen_at timestamp",
}


class Store:
    """The snapshots of a discovery below one folder."""

    def __init__(self, spark: SparkSession, path: str, folders: int = 256):
        for name, schema in SCHEMAS.items():
            setattr(self, name, Snapshot(spark, f"{path.rstrip('/')}/{name}", "osm_key", schema, folders))


def found(docs: DataFrame) -> DataFrame:
    """Named, living POIs of the documents (doc_id, status, body; query_id and country_hint may be there) that are usable."""
    spare = lambda c, kind: (F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c)
    ok = P.triage(docs).filter("ok").select("doc_id", spare("query_id", "bigint"), spare("country_hint", "string"), "body")
    parsed = ok.select("doc_id", "query_id", "country_hint", F.from_json("body", f"elements array<{P.ELEMENT}>")["elements"].alias("elements"))
    rows = unnest_with_position(parsed, ["doc_id", "query_id", "country_hint"], F.col("elements"), "pos", "e")
    return P.normalize(rows.select("doc_id", "pos", "query_id", "country_hint", "e.*").withColumn("tags", F.coalesce("tags", F.create_map().cast("map<string,string>"))))


def stamped(rows: DataFrame, now: str) -> DataFrame:
    """`id` says when a contact was first seen: batch, document, place in it, place among the element's contacts."""
    return rows.withColumn("id", F.struct(F.lit(now).cast("timestamp").alias("batch"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("pos").cast("int").alias("pos"), F.col("ord").cast("int").alias("ord")))


def discover(docs: DataFrame, store: Store, now: str) -> DataFrame:
    """Takes a batch of documents into the store and returns one row of counts: documents, pois, businesses, is_new, folders."""
    spark = docs.sparkSession
    ws = Workspace(spark, "discovery")
    pois = ws.written(found(docs), "pois")
    order = [F.col("doc_id"), F.col("pos")]
    folders = store.businesses.touched(pois)
    part = lambda table: table.read(folders)

    merged = ws.written(P.upsert(part(store.businesses), pois, now, order), "businesses")
    own = pois.withColumn("country_code", F.coalesce("country_hint", "country_code"))
    tied = lambda df: own.select("osm_key", "doc_id", "pos", "country_code", df)
    phones = stamped(P.add_tag_phones(tied(F.col("phones"))), now).withColumn("phone_key", F.coalesce("e164", "raw"))
    emails = stamped(P.add_tag_emails(tied(F.col("emails"))), now)
    at = F.col("id")
    columns = lambda table: spark.createDataFrame([], table.schema).columns
    contacts = {
        "phones": insert_new(part(store.phones), phones.select(*columns(store.phones)), ["osm_key", "phone_key"], [at]),
        "emails": insert_new(part(store.emails), emails.select(*columns(store.emails)), ["osm_key", "address"], [at]),
        "socials": P.upsert_socials(part(store.socials), P.all_socials(pois)).withColumn("has_video", F.coalesce("has_video", F.lit(False))),
    }
    contacts = {name: ws.written(df, name) for name, df in contacts.items()}
    seen = pois.filter("query_id IS NOT NULL").select("osm_key", "query_id", F.lit(now).cast("timestamp").alias("found_at"))
    links = ws.written(insert_new(part(store.links), seen, ["osm_key", "query_id"], [F.col("found_at")]), "links")
    by_id = {name: df.withColumnRenamed("osm_key", "business_id") for name, df in contacts.items()}
    fresh = merged.drop("phone_raw").withColumn("id", F.col("osm_key")).withColumn("enrichment_stage", F.lit(dims.ENRICHMENT_STAGES[0]))
    leads = L.scored(L.denorm(fresh, by_id["phones"], by_id["emails"], by_id["socials"]))

    # the businesses go last: until they are in place, a batch that is run again still knows which of them are new
    for name, df in {**contacts, "links": links, "leads": leads, "businesses": merged}.items():
        getattr(store, name).replace(df)
    counts = merged.join(pois.select("osm_key").distinct(), "osm_key", "left_semi").agg(
        F.count("*").alias("businesses"), F.count_if("is_new").alias("new")).first()
    n_docs, n_pois = docs.count(), pois.count()
    ws.drop()
    return spark.createDataFrame([(n_docs, n_pois, counts.businesses, counts.new, len(folders))], "documents bigint, pois bigint, businesses bigint, new bigint, folders int")
