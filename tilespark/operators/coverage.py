"""Coverages: the tiles they touch, spatial joins against them, and their set algebra.

A coverage row is ``coverage, box struct<minx..maxy>, polygon array<ring>`` (null polygon: the box
itself). Spatial joins never compare every tile with every coverage: a coverage is cut into the
grid cells it touches down to a shallow ``depth`` and tiles meet it by an equi-join on their
ancestor cell. Cells wholly inside need no further test.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.functions import geometry as geo
from tilespark.functions import keys
from tilespark.functions.once import once, once_unless
from tilespark.functions.tilemath import Grid, affected_range
from tilespark.session import cut_lineage

# One row describes at most this many tiles per side before its range is spread over tasks.
BLOCK = 256


def box_columns(box: Column) -> tuple[Column, Column, Column, Column]:
    return box.minx, box.miny, box.maxx, box.maxy


def tile_ranges(boxes: DataFrame, grid: Grid, box: str = "box", z: str = "z") -> DataFrame:
    """Add ``r struct<x0,y0,x1,y1>``, the tiles of level ``z`` each box touches, and their number; null and 0 off the grid."""
    r = affected_range(grid, *box_columns(F.col(box)), F.col(z))
    return once(boxes, "r", r).withColumn(
        "n_tiles", F.coalesce((F.col("r.x1") - F.col("r.x0") + 1) * (F.col("r.y1") - F.col("r.y0") + 1), F.lit(0).cast("long")))


def halves(grid: Grid) -> bool:
    """Each level halves the one above."""
    return all(abs(a / b - 2) <= 1e-9 for a, b in zip(grid.resolutions[:-1], grid.resolutions[1:], strict=True))


def _require_halving(grid: Grid) -> None:
    """Ancestors are found by shifting keys here, which holds only where levels halve; ``density`` takes any grid."""
    if not halves(grid):
        raise ValueError(f"levels of grid {grid.name} do not halve; use density.join_tiles and density.count_tiles_by_rows, or count_box_tiles for boxes")


def within_tile_limit(ranges: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Queries below the tile limit, and the refused ones; decided before any tile exists."""
    return ranges.filter(F.col("n_tiles") < limit), ranges.filter(F.col("n_tiles") >= limit)


def expand_ranges(ranges: DataFrame, spread: bool = False) -> DataFrame:
    """One row per tile of each range.

    With ``spread``, ranges are cut into blocks that are shuffled before they are expanded, so a
    world-sized box at a deep level becomes many tasks instead of one. Ranges known to be small stay
    where they are.
    """
    if not spread:
        return (
            ranges.withColumn("x", F.explode(F.sequence(F.col("r.x0"), F.col("r.x1"))))
            .withColumn("y", F.explode(F.sequence(F.col("r.y0"), F.col("r.y1"))))
            .drop("r", "n_tiles")
        )

    def starts(lo: str, hi: str) -> Column:
        return F.explode(F.sequence(F.col(lo), F.col(hi), F.lit(BLOCK).cast("long")))

    blocks = ranges.withColumn("_bx", starts("r.x0", "r.x1")).withColumn("_by", starts("r.y0", "r.y1"))
    return (
        # the range is part of the key: boxes sharing a popular block do not share a task
        blocks.repartition("_bx", "_by", "r")
        .withColumn("x", F.explode(F.sequence(F.col("_bx"), F.least(F.col("_bx") + BLOCK - 1, F.col("r.x1")))))
        .withColumn("y", F.explode(F.sequence(F.col("_by"), F.least(F.col("_by") + BLOCK - 1, F.col("r.y1")))))
        .drop("_bx", "_by", "r", "n_tiles")
    )


def affected_tiles(boxes: DataFrame, grid: Grid, box: str = "box", spread: bool = False) -> DataFrame:
    """Tiles of level ``z`` touched by each box (both columns of ``boxes``).

    Use ``spread`` for seed tasks and other boxes without a tile limit.
    """
    return expand_ranges(tile_ranges(boxes, grid, box), spread)


def tile_box(grid: Grid) -> Column:
    return grid.tile_bbox(F.col("x"), F.col("y"), F.col("z"))


def _classify(edges: Column, box: Column, tile: Column) -> Column:
    return (
        F.when(~geo.bbox_overlaps(box, tile), geo.NONE)
        .when(edges.isNull(), geo.bbox_relation(box, tile))
        .otherwise(geo.classify_in_edges(edges, tile))
    )


def _keep_touching(df: DataFrame, name: str, state: Column) -> DataFrame:
    return once_unless(df, name, state, geo.NONE)


def coverage_cells(coverages: DataFrame, grid: Grid, depth: int) -> DataFrame:
    """Cells of levels ``0..depth`` each coverage touches, with their class and the edges that matter in them."""
    levelled = coverages.withColumn("edges", geo.polygon_edges(F.col("polygon"))).withColumn(
        "z", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    cells = affected_tiles(levelled, grid).withColumn("tile", tile_box(grid))
    classed = _keep_touching(cells, "cell_class", _classify(F.col("edges"), F.col("box"), F.col("tile")))
    return classed.withColumn("edges", _edges_for(F.col("edges"), F.col("cell_class"), F.col("tile"))).drop("tile")


def _edges_for(edges: Column, state: Column, tile: Column) -> Column:
    """What tests inside a tile need of a polygon: nothing in a contained tile, else the edges beside it or right of it.

    A ray to the right from a point of the tile meets no other edge, and no other edge enters the tile, so
    answers stay the same while a row grows with the edges of the tile's own band only.
    """
    slack = (tile.maxx - tile.minx) * 1e-9
    near = F.filter(edges, lambda e: (F.least(e.p.y, e.q.y) <= tile.maxy + slack) & (F.greatest(e.p.y, e.q.y) >= tile.miny - slack)
                    & (F.greatest(e.p.x, e.q.x) >= tile.minx - slack))
    return F.when(state != geo.CONTAINS, near)


def _salted(left: DataFrame, right: DataFrame, spread_by: Sequence[str], salts: int):
    """Split the rows of one key on the left over ``salts`` sub-keys, repeating the right side."""
    if salts <= 1:
        return left.withColumn("_salt", F.lit(0)), right.withColumn("_salt", F.lit(0))
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    return left.withColumn("_salt", salt), right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def join_coverages(tiles: DataFrame, coverages: DataFrame, grid: Grid, depth: int = 5, salts: int = 1) -> DataFrame:
    """Tiles with every coverage they touch: columns ``coverage`` and ``coverage_class``."""
    _require_halving(grid)
    cells = coverage_cells(coverages, grid, depth).select(
        F.col("z").alias("_cz"), F.col("x").alias("_cx"), F.col("y").alias("_cy"),
        "coverage", "box", "edges", "cell_class")
    keyed = (
        tiles.withColumn("_cz", F.least(F.col("z"), F.lit(depth)))
        .withColumn("_cx", keys.ancestor(F.col("x"), F.col("z"), depth))
        .withColumn("_cy", keys.ancestor(F.col("y"), F.col("z"), depth))
    )
    keyed, cells = _salted(keyed, cells, ("x", "y"), salts)
    settled = (F.col("cell_class") == geo.CONTAINS) | (F.col("z") <= depth)
    state = F.when(settled, F.col("cell_class")).otherwise(_classify(F.col("edges"), F.col("box"), F.col("_tile")))
    met = keyed.join(cells, ["_cz", "_cx", "_cy", "_salt"]).withColumn("_tile", tile_box(grid))
    return _keep_touching(met, "coverage_class", state).select(*tiles.columns, "coverage", "coverage_class")


def points_in_coverages(
    points: DataFrame, coverages: DataFrame, grid: Grid, x: str, y: str, depth: int = 5, salts: int = 1
) -> DataFrame:
    """Points with every coverage holding them."""
    level = F.lit(depth)
    cells = coverage_cells(coverages, grid, depth).filter(F.col("z") == depth).select(
        F.col("x").alias("_cx"), F.col("y").alias("_cy"), "coverage", "box", "edges", "cell_class")
    keyed = points.withColumn("_cx", grid.tile_x(F.col(x), level)).withColumn("_cy", grid.tile_y(F.col(y), level))
    keyed, cells = _salted(keyed, cells, (x, y), salts)
    px, py, box = F.col(x), F.col(y), F.col("box")
    in_box = (px >= box.minx) & (px < box.maxx) & (py >= box.miny) & (py < box.maxy)
    inside = (
        F.when((F.col("cell_class") == geo.CONTAINS), True)
        .when(~in_box, False)
        .otherwise(F.col("edges").isNull() | geo.point_in_edges(F.col("edges"), px, py))
    )
    return keyed.join(cells, ["_cx", "_cy", "_salt"]).filter(inside).select(*points.columns, "coverage")


def _descendants(cells: DataFrame, grid: Grid, z: int, steps: int) -> DataFrame:
    """Tiles of the next ``steps`` levels below cells of level ``z``, inside their matrix."""
    level = F.explode(F.sequence(F.lit(1), F.lit(steps)))
    side = F.pow(F.lit(2.0), F.col("_k")).cast("long")
    opened = (
        cells.withColumn("_k", level)
        .withColumn("_dx", F.explode(F.sequence(F.lit(0).cast("long"), side - 1)))
        .withColumn("_dy", F.explode(F.sequence(F.lit(0).cast("long"), side - 1)))
    )
    below = opened.select(
        "coverage", "box", "edges", (F.lit(z) + F.col("_k")).alias("z"),
        (F.col("x") * side + F.col("_dx")).alias("x"), (F.col("y") * side + F.col("_dy")).alias("y"))
    return below.filter(keys.in_matrix(F.col("x"), F.col("y"), grid.grid_w(F.col("z")), grid.grid_h(F.col("z"))))


def count_tiles(coverages: DataFrame, grid: Grid, levels: int, stride: int = 4) -> DataFrame:
    """Distinct tiles per coverage and level, without listing them all.

    The descent goes ``stride`` levels at a time and only opens cells the coverage's edge runs
    through: a cell wholly inside stands for 4^k tiles k levels below. Stages deeper than the
    second start from a checkpointed frontier. Grids whose levels do not halve are refused.
    """
    _require_halving(grid)
    top = min(stride, levels - 1)
    cells = coverage_cells(coverages, grid, top).withColumnRenamed("cell_class", "state")
    one = F.lit(1).cast("long")
    parts = [cells.select("coverage", "z", one.alias("tiles"))]
    while top < levels - 1:
        bottom = cells.filter(F.col("z") == top)
        deeper = F.explode(F.sequence(F.lit(top + 1), F.lit(levels - 1)))
        parts.append(bottom.filter(F.col("state") == geo.CONTAINS).select("coverage", deeper.alias("z")).select(
            "coverage", "z", F.pow(F.lit(4.0), F.col("z") - top).cast("long").alias("tiles")))
        steps = min(stride, levels - 1 - top)
        below = _descendants(bottom.filter(F.col("state") == geo.INTERSECTS), grid, top, steps).withColumn(
            "tile", tile_box(grid))
        cells = _keep_touching(below, "state", _classify(F.col("edges"), F.col("box"), F.col("tile")))
        cells = cells.withColumn("edges", _edges_for(F.col("edges"), F.col("state"), F.col("tile"))).drop("tile")
        top += steps
        if top < levels - 1:
            cells = cut_lineage(cells)
        parts.append(cells.select("coverage", "z", one.alias("tiles")))
    counted = parts[0]
    for part in parts[1:]:
        counted = counted.unionByName(part)
    return counted.groupBy("coverage", "z").agg(F.sum("tiles").alias("tiles"))


def count_box_tiles(boxes: DataFrame, grid: Grid) -> DataFrame:
    """Closed form of :func:`count_tiles` for plain boxes: width times height of the range."""
    return tile_ranges(boxes, grid).drop("r")


def combine_tile_sets(parts: DataFrame, by: Sequence[str], operation: str) -> DataFrame:
    """Set algebra over tile sets: ``parts`` holds (by, part, n_parts, z, x, y).

    One aggregation with map-side combine answers all three operations: a tile is in the union when
    any part has it, in the intersection when all have it, in the difference when only part 0 has it.
    """
    keep = {
        "union": F.lit(True),
        "intersection": F.col("_held") == F.col("_parts"),
        "difference": F.col("_last") == 0,
    }[operation]
    held = parts.select(*by, "part", "n_parts", "z", "x", "y").distinct().groupBy(*by, "z", "x", "y").agg(
        F.count(F.lit(1)).alias("_held"), F.max("n_parts").alias("_parts"), F.max("part").alias("_last"))
    return held.filter(keep).select(*by, "z", "x", "y")


def compact_tiles(tiles: DataFrame, min_zoom: int = 0) -> DataFrame:
    """Drop tiles that lie below another tile of the set (a coverage given as an expire list)."""
    distinct = tiles.select("z", "x", "y").distinct()
    above = distinct.filter(F.col("z") > min_zoom).select("z", "x", "y", F.explode(
        F.sequence(F.lit(min_zoom), F.col("z") - 1)).alias("az")).select(
        "z", "x", "y", "az", keys.ancestor(F.col("x"), F.col("z"), F.col("az")).alias("ax"),
        keys.ancestor(F.col("y"), F.col("z"), F.col("az")).alias("ay"))
    upper = distinct.select(F.col("z").alias("az"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    covered = above.join(upper, ["az", "ax", "ay"], "left_semi").select("z", "x", "y")
    return distinct.join(covered, ["z", "x", "y"], "left_anti")


def clip_queries(queries: DataFrame, extent: str = "extent") -> DataFrame:
    """Cut map queries to an extent: whole, partial (with the sub-image to ask for) or empty."""
    query, limit = F.col("box"), F.col(extent)
    relation = geo.bbox_relation(limit, query)
    clipped = once(queries.withColumn("_relation", relation), "sub", F.when(
        F.col("_relation") == geo.INTERSECTS, geo.sub_image(query, F.col("width"), F.col("height"), limit)))
    outcome = (
        F.when(F.col("_relation") == geo.CONTAINS, "whole")
        .when((F.col("_relation") == geo.NONE) | (F.col("sub.width") == 0) | (F.col("sub.height") == 0), "empty")
        .otherwise("partial")
    )
    return clipped.withColumn("outcome", outcome).drop("_relation")


def tile_aligned(box: Column, tile: Column, width: Column, height: Column) -> Column:
    """Box and tile agree within a tenth of a pixel."""
    return geo.bbox_equals(
        tile, box, F.abs((tile.maxx - tile.minx) / width / 10), F.abs((tile.maxy - tile.miny) / height / 10))
