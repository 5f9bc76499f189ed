"""Meta tiles, minimal meta requests and key checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.functions import keys
from tilespark.functions.tilemath import Grid


def meta_tiles(tiles: DataFrame, meta: int) -> DataFrame:
    """Add the main tile (mx, my) of each tile's meta tile."""
    return tiles.withColumn("mx", keys.main_tile(F.col("x"), meta)).withColumn("my", keys.main_tile(F.col("y"), meta))


def meta_members(metas: DataFrame, grid: Grid, meta: int) -> DataFrame:
    """Member tiles of meta tiles with their crop offset, clamped to the matrix."""
    z = F.col("z")
    last_x = F.least(F.col("mx") + meta, grid.grid_w(z)) - 1
    last_y = F.least(F.col("my") + meta, grid.grid_h(z)) - 1
    return (
        metas
        .withColumn("x", F.explode(F.sequence(F.col("mx"), last_x)))
        .withColumn("y", F.explode(F.sequence(F.col("my"), last_y)))
        .withColumn("off_x", (F.col("x") - F.col("mx")) * grid.tile_size)
        .withColumn("off_y", (F.col("y") - F.col("my")) * grid.tile_size)
    )


def minimal_meta(tiles: DataFrame, by: Sequence[str]) -> DataFrame:
    """One request per query: the smallest block of tiles around those asked for."""
    return tiles.groupBy(*by).agg(
        F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"),
    ).withColumn("block_w", F.col("x1") - F.col("x0") + 1).withColumn("block_h", F.col("y1") - F.col("y0") + 1)


def key_verdict(grid: Grid) -> Column:
    """``ok``, or why a key cannot name a tile; levels past the grid use its finest matrix."""
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    level = F.greatest(F.least(z, F.lit(grid.levels - 1)), F.lit(0))
    return (
        F.when((z < 0) | (z > keys.MAX_ZOOM), "zoom")
        .when((x < 0) | (y < 0), "negative")
        .when(~keys.in_matrix(x, y, grid.grid_w(level), grid.grid_h(level)), "outside")
        .otherwise("ok")
    )
