"""Grids that take their levels from other grids, and level choice with explicit transitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.functions.once import bind
from tilespark.functions.tilemath import STRETCH_FACTOR, TILE_SIZE, grid_levels
from tilespark.session import cut_lineage


def _ratio(levels: Column) -> Column:
    """Ratio of the first two resolutions, to 8 places; null without two."""
    return F.when(F.size(levels) >= 2, F.round(F.get(levels, F.lit(0)) / F.get(levels, F.lit(1)), 8))


def aligned_resolutions(theirs: Column, first: Column, min_res: Column, num_levels: Column, factor: Column) -> Column:
    """A grid's resolutions out of another grid's, coarse to fine: those no coarser than ``first`` and no finer than
    ``min_res``, at most ``num_levels`` of them. A ``sqrt2`` grid along a halving one has a level between any two and
    after the last; a halving grid along a ``sqrt2`` one has every second level."""
    kept = F.filter(theirs, lambda r: (r <= first) & (min_res.isNull() | (r >= min_res)))
    cut = F.when(num_levels.isNull(), kept).otherwise(F.slice(kept, F.lit(1), F.greatest(num_levels, F.lit(0))))
    root = round(math.sqrt(2), 8)

    def adapt(levels: Column) -> Column:
        doubled = F.flatten(F.transform(levels, lambda r: F.array(r, r / F.sqrt(F.lit(2.0)))))
        return F.when((factor == "sqrt2") & (_ratio(levels) == 2.0), doubled).when(
            (factor == "2") & (_ratio(levels) == root), F.filter(levels, lambda r, i: i % 2 == 0)).otherwise(levels)

    return bind(cut, adapt)


def aligned_grid_levels(options: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Level lists of grids some of which are aligned with others: ``grid, resolutions``, and the grids left without levels: ``grid,
    align_with, reason``.

    ``options``: the columns of ``tilemath.grid_levels`` with ``align_with``, the name of another grid or null; names are unique.
    Grids are resolved in rounds, each by a join with those that were resolved in the round before, so the rounds are as
    many as the longest chain; each round is written. Grids in a circle, or behind one, get ``circular``, those that lead to no
    grid ``unknown``.
    """
    size = F.coalesce("tile_size", F.lit(TILE_SIZE))
    rows = options.withColumn("_factor", F.coalesce(F.col("res_factor").cast("string"), F.lit("2"))).withColumn(
        "_first", F.coalesce("max_res", F.greatest((F.col("maxx") - F.col("minx")) / size, (F.col("maxy") - F.col("miny")) / size)))
    own = rows.filter(F.col("align_with").isNull())
    levels = grid_levels(own).groupBy("grid").agg(F.transform(F.sort_array(F.collect_list(F.struct("z", "res"))), lambda x: x.res).alias("resolutions"))
    done = cut_lineage(levels)
    pending = cut_lineage(rows.filter(F.col("align_with").isNotNull()).select("grid", "align_with", "_first", "min_res", "num_levels", "_factor"))
    newest, found = done, [done]
    while not newest.isEmpty() and not pending.isEmpty():
        with_theirs = pending.join(newest.select(F.col("grid").alias("_g"), F.col("resolutions").alias("_theirs")), F.col("align_with") == F.col("_g"))
        newest = cut_lineage(with_theirs.select("grid", aligned_resolutions(
            F.col("_theirs"), F.col("_first"), F.col("min_res"), F.col("num_levels"), F.col("_factor")).alias("resolutions")))
        found.append(newest)
        pending = cut_lineage(pending.join(newest.select("grid"), "grid", "left_anti"))
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out, _unresolved(pending.select("grid", "align_with"), options.select("grid"))


def _unresolved(pending: DataFrame, known: DataFrame) -> DataFrame:
    """Why grids have no levels: those that lead to a name that is no grid, in rounds back from there; the others lead to a circle."""
    lost = cut_lineage(pending.join(known.select(F.col("grid").alias("_g")), F.col("align_with") == F.col("_g"), "left_anti"))
    newest, found = lost, lost
    rest = cut_lineage(pending.join(lost.select("grid"), "grid", "left_anti"))
    while not newest.isEmpty() and not rest.isEmpty():
        newest = cut_lineage(rest.join(newest.select(F.col("grid").alias("_g")), F.col("align_with") == F.col("_g"), "left_semi"))
        found = found.unionByName(newest)
        rest = cut_lineage(rest.join(newest.select("grid"), "grid", "left_anti"))
    return found.withColumn("reason", F.lit("unknown")).unionByName(rest.withColumn("reason", F.lit("circular")))


def level_with_thresholds(resolutions: Column, thresholds: Column, res: Column, stretch: float = STRETCH_FACTOR) -> Column:
    """Level for a requested resolution when some transitions between levels are set explicitly.

    A threshold between two neighbouring levels decides between them: coarser requests take the level above, the threshold
    itself and finer ones, down to the level's own resolution, the level below. All other requests take the last level within the
    stretch factor before one finer than the request, else the finest. ``resolutions`` run from coarse to fine; ``thresholds`` (null: none)
    are in any order; those coarser than the first level decide nothing.
    """
    marks = F.filter(F.sort_array(F.coalesce(thresholds, F.array().cast("array<double>")), asc=False), lambda t: t <= F.get(resolutions, F.lit(0)))
    nothing = F.lit(None).cast("int")
    start = F.struct(F.get(resolutions, F.lit(0)).alias("before"), F.lit(0).alias("mark"), F.lit(0).alias("level"), nothing.alias("near"), nothing.alias("out"))

    def step(s: Column, r: Column) -> Column:
        mark = F.get(marks, s.mark)
        between = F.coalesce((s.before > mark) & (mark >= r), F.lit(False))
        by_mark = F.when(between & (res > mark), s.level - 1).when(between & (res >= r), s.level)
        by_near = F.when(s.near.isNotNull() & (r < res), s.near)
        return F.struct(
            r.alias("before"), (s.mark + between.cast("int")).alias("mark"), (s.level + 1).alias("level"),
            F.when(r <= res * stretch, s.level).otherwise(s.near).alias("near"), F.coalesce(s.out, by_mark, by_near).alias("out"))

    return bind(F.aggregate(resolutions, start, step), lambda s: F.coalesce(s.out, s.level - 1))
