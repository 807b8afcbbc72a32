"""Connected components of a table of links."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

EDGES = "u bigint, v bigint"


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Links every larger (or, for the small star, smaller) neighbour of a node, and there the node itself, to the least of them all."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.filter("v < u")
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    far = near.filter("v > u") if large else near
    joined = far.join(least, "u")
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (u, v): label is the least node of its component. Large and small stars
    alternate until they change nothing; each state is a written table, so lineage stays short."""
    state = written(edges.select("u", "v").filter("u != v").distinct(), "edges")
    before = None
    while True:
        state = written(star(star(state, True), False), "edges")
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    return state.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
