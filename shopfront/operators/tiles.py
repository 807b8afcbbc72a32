"""Adaptive map tiles and the checks on tile responses."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dims


def adaptive_tiles(points: DataFrame, bbox: tuple[float, float, float, float], cap: int = dims.ELEMENT_CAP) -> DataFrame:
    """Adds (depth, cell_y, cell_x): the shallowest tile of each point that needs no split.

    A tile is split in four while it holds `cap` points or more, is above the depth limit and
    wide enough. Points are counted once, on the finest grid (at most 256 cells); the counts
    of coarser tiles and the choice of depth come from that small table, which is then
    broadcast back, so the points themselves are never shuffled.
    """
    south, west, north, east = bbox
    last = 2 ** dims.MAX_TILE_DEPTH - 1
    index = lambda col, low, high: F.greatest(F.lit(0), F.least(F.lit(last), F.floor(
        (F.col(col) - low) / ((high - low) / 2 ** dims.MAX_TILE_DEPTH)))).cast("int")
    inside = points.filter(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    fine = inside.withColumns({"_y": index("lat", south, north), "_x": index("lon", west, east)})
    counts = fine.groupBy("_y", "_x").agg(F.count("*").alias("n"))
    depths = range(dims.MAX_TILE_DEPTH + 1)
    tiles = counts.withColumn("depth", F.explode(F.array(*map(F.lit, depths))))
    tiles = tiles.withColumns({"cell_y": F.expr(f"shiftright(_y, {dims.MAX_TILE_DEPTH} - depth)"),
                               "cell_x": F.expr(f"shiftright(_x, {dims.MAX_TILE_DEPTH} - depth)")})
    # at most 256 cells at 5 depths, so this window is small
    tiles = tiles.withColumn("total", F.sum("n").over(Window.partitionBy("depth", "cell_y", "cell_x")))
    span = max(north - south, east - west)
    narrow = F.lit(span) / F.pow(F.lit(2.0), F.col("depth")) <= 2 * dims.MIN_TILE_DEGREES
    final = tiles.filter((F.col("total") < cap) | (F.col("depth") == dims.MAX_TILE_DEPTH) | narrow)
    chosen = final.groupBy("_y", "_x").agg(F.min(F.struct("depth", "cell_y", "cell_x", "total")).alias("t"))
    return fine.join(F.broadcast(chosen), ["_y", "_x"]).select(
        *points.columns, "t.depth", "t.cell_y", "t.cell_x", F.col("t.total").alias("tile_points"))


def coverage_check(responses: DataFrame) -> DataFrame:
    """Sources that answered a tile with nothing where another source found something."""
    answered = responses.filter("ok")
    per = answered.groupBy("tile", "source").agg(F.max("n_elements").alias("most"), F.count_if(F.col("n_elements") == 0).alias("n_empty"))
    richest = per.groupBy("tile").agg(F.count_if(F.col("most") > 0).alias("sources"), F.max("most").alias("tile_most"))
    df = per.join(richest, "tile").withColumn("others", F.col("sources") - F.when(F.col("most") > 0, 1).otherwise(0))
    return df.filter("n_empty > 0 AND others > 0").groupBy("source").agg(
        F.count("*").alias("tiles"), F.sum("n_empty").alias("n_empty"))


def area_fallback(requests: DataFrame, area_hits: DataFrame, box_hits: DataFrame) -> DataFrame:
    """Hits of each run: those of the area query, or of the box query where the area gave nothing."""
    by_area = requests.join(area_hits, "query_id", "left_semi").select("query_id", F.lit(True).alias("used_area"))
    area = area_hits.withColumn("used_area", F.lit(True))
    box = box_hits.join(by_area, "query_id", "left_anti").withColumn("used_area", F.lit(False))
    return area.unionByName(box).join(requests, "query_id", "left_semi")
