"""Possible duplicates of leads: same web domain, or same name within about 50 metres.

The set of duplicate pairs grows with the square of a group (a chain with a million
branches on one domain has half a trillion pairs), so no job lists it. Each lead gets,
per reason, the number of its partners and the least id of its group: the same pairs,
in a table no longer than the leads. The page of pairs people look at is read from that.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from .near_counts import within_reach

COLUMNS = ["business_id", "reason", "n_partners", "group_id"]


def keyed(leads: DataFrame, faithful: bool) -> DataFrame:
    """Comparison keys. Unless faithful, keys shared by unrelated leads are left out:
    social and link-hub domains, bare addresses, and empty names."""
    key = F.lower("dedupe_key")
    name = F.col("name_normalized")
    if not faithful:
        shared = [*dims.SOCIAL_HOSTS, *dims.LINK_HUB_HOSTS]
        key = F.when(key.contains(".") & ~key.contains(" ") & ~key.isin(shared), key)
        name = F.nullif(name, F.lit(""))
    return leads.select("id", key.alias("key"), name.alias("name"), "lat", "lon")


def same_domain(k: DataFrame) -> DataFrame:
    """Partners by key: group size less one. The group table has one row per key and joins back with skew handling."""
    groups = k.filter("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("group_id")).filter("n > 1")
    return k.join(groups, "key").select(
        F.col("id").alias("business_id"), F.lit("same_domain").alias("reason"), (F.col("n") - 1).alias("n_partners"), "group_id")


def same_name_nearby(k: DataFrame) -> DataFrame:
    """Partners by name and place that are not already partners by key.

    Counted as all leads of the name in reach, less those in reach that share the key. Leads at one spot are one place.
    """
    k = k.filter("lat IS NOT NULL AND lon IS NOT NULL AND name IS NOT NULL")
    place = ["name", "lat", "lon"]
    count = lambda keys: k.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("least"))
    everyone = within_reach(count(place), ["name"], dims.NEAR_DEGREES).withColumnRenamed("least", "group_id")
    same = within_reach(count([*place, "key"]).filter("key IS NOT NULL"), ["name", "key"], dims.NEAR_DEGREES).select(*place, "key", F.col("reach").alias("same_reach"))
    df = k.join(everyone, place).join(same, [*place, "key"], "left")
    n = F.col("reach") - F.coalesce("same_reach", F.lit(1))
    return df.select(F.col("id").alias("business_id"), F.lit("same_name_nearby").alias("reason"), n.alias("n_partners"), "group_id").filter(
        "n_partners > 0")


def possible_duplicates(leads: DataFrame, faithful: bool = False) -> DataFrame:
    """(business_id, reason, n_partners, group_id) of every lead with a possible duplicate."""
    k = keyed(leads, faithful)
    return same_domain(k).unionByName(same_name_nearby(k)).select(*COLUMNS)


def duplicate_page(leads: DataFrame, n: int = 200, faithful: bool = False) -> DataFrame:
    """The first n pairs by (business_a, business_b).

    Pairs start at leads that have a later partner. A lead that is the least of its group has
    one; the n leads with the lowest ids among those with any later partner carry the page.
    They are at most n rows, so they are broadcast, and every partition of the leads keeps at
    most n pairs.
    """
    k = keyed(leads, faithful)
    last_of_key = k.filter("key IS NOT NULL").groupBy("key").agg(F.max("id").alias("last"))
    by_key = k.join(last_of_key, "key").filter("id < last").select("id")
    place = ["name", "lat", "lon"]
    spots = k.filter("lat IS NOT NULL AND lon IS NOT NULL AND name IS NOT NULL")
    # the greatest id in reach: least of the negated ids
    far = within_reach(spots.groupBy(*place).agg(F.count("*").alias("n"), F.min(-F.col("id")).alias("least")), ["name"], dims.NEAR_DEGREES)
    by_name = spots.join(far, place).filter(F.col("id") < -F.col("least")).select("id")
    first = by_key.unionByName(by_name).distinct().orderBy("id").limit(n)
    a = F.broadcast(k.join(F.broadcast(first), "id")).alias("a")
    b = k.alias("b")
    same = F.col("a.key").isNotNull() & (F.col("a.key") == F.col("b.key"))
    key_pairs = b.join(a, F.col("a.key") == F.col("b.key")).filter("a.id < b.id")
    name_pairs = b.join(a, F.col("a.name") == F.col("b.name")).filter("a.id < b.id").filter(
        (F.abs(F.col("a.lat") - F.col("b.lat")) < dims.NEAR_DEGREES) & (F.abs(F.col("a.lon") - F.col("b.lon")) < dims.NEAR_DEGREES)
        & ~F.coalesce(same, F.lit(False)))
    out = lambda df, reason: df.select(F.col("a.id").alias("business_a"), F.col("b.id").alias("business_b"), F.lit(reason).alias("reason")).orderBy(
        "business_a", "business_b").limit(n)
    return out(key_pairs, "same_domain").unionByName(out(name_pairs, "same_name_nearby")).orderBy("business_a", "business_b").limit(n)
