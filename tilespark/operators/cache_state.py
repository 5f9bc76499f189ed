"""Cache state: what is stored, missing, stale, and how imports and cleanups change it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.functions import keys
from tilespark.functions.geometry import bbox, reproject_bbox
from tilespark.functions.once import once
from tilespark.functions.tilemath import Grid, affected_range

KEY = ("z", "x", "y")


def latest(tiles: DataFrame, by: Sequence[str] = KEY, order: Sequence[str] = ("mtime",)) -> DataFrame:
    """Last write wins: one row per key, combined on the map side.

    Whole rows are compared, so select the columns needed beforehand.
    """
    rest = [c for c in tiles.columns if c not in by]
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    picked = tiles.groupBy(*by).agg(F.max_by(F.struct(*rest), rank).alias("_last"))
    return picked.select(*by, "_last.*").select(*tiles.columns)


def distinct_tiles(tiles: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    return tiles.dropDuplicates(list(by))


def missing(wanted: DataFrame, stored: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    return wanted.join(stored.select(*by), list(by), "left_anti").select(*wanted.columns)


def stale(stored: DataFrame, wanted: DataFrame, expire: Column, by: Sequence[str] = KEY) -> DataFrame:
    """Wanted tiles written before the expire time; the age test reaches the scan of the store."""
    return stored.filter(F.col("mtime") < expire).join(wanted.select(*by), list(by), "left_semi")


def fresh(stored: DataFrame, wanted: DataFrame, expire: Column, by: Sequence[str] = KEY) -> DataFrame:
    return stored.filter(F.col("mtime") >= expire).join(wanted.select(*by), list(by), "left_semi")


def with_state(requests: DataFrame, stored: DataFrame, expire: Column, by: Sequence[str] = KEY) -> DataFrame:
    """Add ``state`` (hit, stale, miss) to rows keyed by tile.

    Only the newest write time of a key matters, so a store with several writes per key is reduced
    to that by a plain hash aggregate, which also partitions it for the join.
    """
    known = stored.groupBy(*by).agg(F.max("mtime").alias("_mtime"))
    state = F.when(F.col("_mtime").isNull(), "miss").when(F.col("_mtime") < expire, "stale").otherwise("hit")
    return requests.join(known, list(by), "left").withColumn("state", state).drop("_mtime")


def request_heat(requests: DataFrame, stored: DataFrame, expire: Column, by: Sequence[str] = KEY) -> DataFrame:
    """Requests and errors per tile with the tile's state; counted before the join, so a tile that
    draws a third of all traffic joins as one row."""
    heat = requests.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return with_state(heat, stored, expire, by)


def access_metrics(requests: DataFrame, stored: DataFrame, expire: Column) -> DataFrame:
    """Hits, misses and errors by service, layer and level, with their totals."""
    per_tile = requests.groupBy("service", "layer", *KEY).agg(
        F.count_if(F.col("event_type") != "error").alias("served"),
        F.count_if(F.col("event_type") == "error").alias("errors"))
    judged = with_state(per_tile, stored, expire)
    hit = F.col("state") == "hit"
    return judged.rollup("service", "layer", "z").agg(
        F.sum(F.when(hit, F.col("served")).otherwise(0)).alias("hits"),
        F.sum(F.when(hit, 0).otherwise(F.col("served"))).alias("misses"),
        F.sum("errors").alias("errors"), F.sum("served").alias("requests"))


def merge_import(stored: DataFrame, imported: DataFrame, overwrite: bool, by: Sequence[str] = KEY) -> DataFrame:
    """Imported tiles replace stored ones when forced, else only fill gaps."""
    winner, loser = (imported, stored) if overwrite else (stored, imported)
    return winner.unionByName(loser.join(winner.select(*by), list(by), "left_anti"))


def cleanup(stored: DataFrame, doomed: DataFrame, remove_before: Column, by: Sequence[str] = KEY) -> DataFrame:
    """What remains after removing covered tiles older than ``remove_before``."""
    aged = doomed.select(*by).distinct().withColumn("_doomed", F.lit(True))
    marked = stored.join(aged, list(by), "left")
    gone = F.coalesce(F.col("_doomed"), F.lit(False)) & (F.col("mtime") < remove_before)
    return marked.filter(~gone).drop("_doomed")


def can_skip(old: Column, current: Column) -> Column:
    """Work at ``current`` lies before the saved path ``old`` (arrays of comparable steps)."""
    shared = F.least(F.size(old), F.size(current))
    behind = F.slice(old, 1, shared) > F.slice(current, 1, shared)
    return F.when(old.isNull() | current.isNull(), False).when(F.size(old) == 0, True).when(
        shared == 0, False).otherwise(behind)


def rekey(tiles: DataFrame, src: Grid, dst: Grid) -> tuple[DataFrame, DataFrame]:
    """Tiles keyed in another grid, and those whose box covers other than one target tile.

    Adds ``nz, nx, ny`` to the first result and ``n_tiles`` to the second.
    """
    box = src.tile_bbox(F.col("x"), F.col("y"), F.col("z"))
    moved = once(tiles, "_box", reproject_bbox(box, src.srs, dst.srs))
    res = F.least((F.col("_box.maxx") - F.col("_box.minx")), (F.col("_box.maxy") - F.col("_box.miny"))) / dst.tile_size
    levelled = once(moved, "nz", dst.closest_level(res))
    ranged = once(levelled, "_r", affected_range(
        dst, *[F.col(f"_box.{c}") for c in ("minx", "miny", "maxx", "maxy")], F.col("nz")))
    counted = ranged.withColumn(
        "n_tiles", F.coalesce((F.col("_r.x1") - F.col("_r.x0") + 1) * (F.col("_r.y1") - F.col("_r.y0") + 1), F.lit(0).cast("long")))
    one = counted.filter("n_tiles = 1").select(
        *tiles.columns, "nz", F.col("_r.x0").alias("nx"), F.col("_r.y0").alias("ny"))
    return one, counted.filter("n_tiles <> 1").select(*tiles.columns, "n_tiles")


def overlap_tiles(targets: DataFrame, dst: Grid, src: Grid, src_level: Column) -> DataFrame:
    """Source tiles under each target tile, with their place in the source block.

    Adds ``sz, sx, sy`` and the pixel offset of the source tile in the mosaic of its block.
    """
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    box = dst.tile_bbox(x, y, z)
    if dst.srs == "EPSG:4326" and src.srs != "EPSG:4326":
        from tilespark.functions.tilemath import LAT_LIMIT

        box = bbox(box.minx, F.greatest(box.miny, F.lit(-LAT_LIMIT)), box.maxx, F.least(box.maxy, F.lit(LAT_LIMIT)))
    moved = once(targets.withColumn("sz", src_level), "_box", reproject_bbox(box, dst.srs, src.srs))
    ranged = once(moved, "_r", affected_range(
        src, *[F.col(f"_box.{c}") for c in ("minx", "miny", "maxx", "maxy")], F.col("sz")))
    return (
        ranged.withColumn("sx", F.explode(F.sequence(F.col("_r.x0"), F.col("_r.x1"))))
        .withColumn("sy", F.explode(F.sequence(F.col("_r.y0"), F.col("_r.y1"))))
        .withColumn("off_x", (F.col("sx") - F.col("_r.x0")) * src.tile_size)
        .withColumn("off_y", (F.col("sy") - F.col("_r.y0")) * src.tile_size)
        .drop("_box", "_r")
    )


def nearest_levels(wanted: DataFrame, stored: DataFrame, up: int = 0, down: int = 0) -> DataFrame:
    """Fill wanted tiles from themselves, else from ancestors or descendants a few levels away.

    ``up``/``down`` bound the search. Every candidate is one equi-join row: ancestors by shifting the
    wanted key, descendants by shifting the stored key, so no level needs its own join. Adds
    ``src_z`` (level used, null when none; of two as near the coarser) and ``n_src`` (tiles of that level found).
    """
    z = F.col("z")
    asked = wanted.select(*KEY).distinct().select(*KEY, F.explode(
        F.sequence(F.greatest(z - up, F.lit(0)), z)).alias("_sz"))
    above = asked.select(
        *KEY, F.col("_sz").alias("sz"), keys.ancestor(F.col("x"), z, F.col("_sz")).alias("sx"),
        keys.ancestor(F.col("y"), z, F.col("_sz")).alias("sy"))
    held = stored.select(F.col("z").alias("sz"), F.col("x").alias("sx"), F.col("y").alias("sy")).distinct()
    found = above.join(held, ["sz", "sx", "sy"]).select(*KEY, "sz")
    if down:
        lower = held.select("sz", "sx", "sy", F.explode(F.sequence(
            F.greatest(F.col("sz") - down, F.lit(0)), F.col("sz") - 1)).alias("z")).filter("z < sz").select(
            "z", keys.ancestor(F.col("sx"), F.col("sz"), F.col("z")).alias("x"),
            keys.ancestor(F.col("sy"), F.col("sz"), F.col("z")).alias("y"), "sz")
        counted = lower.groupBy(*KEY, "sz").agg(F.count(F.lit(1)).alias("_n"))
        found = found.withColumn("_n", F.lit(1).cast("long")).unionByName(
            counted.join(wanted.select(*KEY).distinct(), list(KEY), "left_semi"))
    else:
        found = found.withColumn("_n", F.lit(1).cast("long"))
    best = found.groupBy(*KEY).agg(F.min_by(F.struct(F.col("sz").alias("src_z"), F.col("_n").alias("n_src")),
                                            F.struct(F.abs(F.col("sz") - z), "sz")).alias("_b"))
    return wanted.join(best, list(KEY), "left").select(
        *wanted.columns, F.col("_b.src_z").alias("src_z"), F.coalesce(F.col("_b.n_src"), F.lit(0)).alias("n_src"))


def apply_filters(tiles: DataFrame, filters: Sequence[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Run pre-store filters in order over tiles not stored yet; stored tiles pass untouched."""
    pending = tiles.filter(~F.col("stored"))
    for step in filters:
        pending = pending.transform(step)
    return tiles.filter("stored").unionByName(pending)
