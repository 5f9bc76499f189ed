"""Tileset metadata, statistics, availability and task progress."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.functions.geometry import bbox, reproject_bbox
from tilespark.functions.tilemath import WEBMERCATOR, Grid, tile_bounds
from tilespark.operators.ordering import RUN_BLOCK, runs


def _key_bounds(grid: Grid) -> Column:
    """Lon/lat box of the tiles ``x0..x1, y0..y1`` of level ``z`` in any grid."""
    z = F.col("z")
    if grid == WEBMERCATOR:
        upper, lower = tile_bounds(F.col("x0"), F.col("y0"), z), tile_bounds(F.col("x1"), F.col("y1"), z)
        return bbox(upper.minx, lower.miny, lower.maxx, upper.maxy)
    a, b = grid.tile_bbox(F.col("x0"), F.col("y0"), z), grid.tile_bbox(F.col("x1"), F.col("y1"), z)
    box = bbox(a.minx, F.least(a.miny, b.miny), b.maxx, F.greatest(a.maxy, b.maxy))
    return reproject_bbox(box, grid.srs, "EPSG:4326")


def tileset_metadata(
    tiles: DataFrame, fmt: str = "png", by: str = "tileset", res_factor: str = "2", grid: Grid = WEBMERCATOR,
) -> DataFrame:
    """Zoom range, lon/lat bounds and centre per tileset of ``grid``; key ranges are taken before any geometry."""
    per_level = tiles.groupBy(by, "z").agg(
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    box = F.col("_box")
    merged = per_level.withColumn("_box", _key_bounds(grid)).groupBy(by).agg(
        F.min("z").alias("min_zoom"), F.max("z").alias("max_zoom"),
        F.min(box.minx).alias("minx"), F.min(box.miny).alias("miny"), F.max(box.maxx).alias("maxx"), F.max(box.maxy).alias("maxy"))
    return (
        merged.withColumn("center_x", (F.col("minx") + F.col("maxx")) / 2)
        .withColumn("center_y", (F.col("miny") + F.col("maxy")) / 2)
        .withColumn("format", F.lit(fmt)).withColumn("res_factor", F.lit(res_factor))
    )


def availability(tiles: DataFrame, by: Sequence[str] = ("tileset", "z"), block: int = RUN_BLOCK) -> DataFrame:
    """Rectangles of existing tiles per level: runs along rows, equal runs joined down the rows."""
    by = list(by)
    along = runs(tiles, [*by, "y"], "x", block).withColumnsRenamed({"first": "start_x", "last": "end_x"})
    return runs(along, [*by, "start_x", "end_x"], "y", block).withColumnsRenamed({"first": "start_y", "last": "end_y"})


def task_progress(reports: DataFrame, task: str, done: Column, at: str) -> DataFrame:
    """Completed share and duration per task; a task without work has no share."""
    agg = reports.groupBy(task).agg(
        F.count_if(done).alias("completed"), F.count(F.lit(1)).alias("total"),
        F.min(at).alias("start_time"), F.max(at).alias("updated_at"))
    return agg.withColumn("progress", F.when(F.col("total") > 0, F.col("completed") / F.col("total")))


def merge_resolution_ranges(layers: DataFrame, by: Sequence[str]) -> DataFrame:
    """Widest range over layers; one unbounded layer leaves its end open."""
    open_lo, open_hi = F.bool_or(F.col("min_res").isNull()), F.bool_or(F.col("max_res").isNull())
    return layers.groupBy(*by).agg(
        F.when(~open_lo, F.max("min_res")).alias("min_res"), F.when(~open_hi, F.min("max_res")).alias("max_res"))


def merge_extents(layers: DataFrame, by: Sequence[str]) -> DataFrame:
    return layers.groupBy(*by).agg(
        F.min("minx").alias("minx"), F.min("miny").alias("miny"),
        F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))
