"""Raster tiles as arrays: mosaics, splits, borders, pyramids, sampling, warping and masks.

A tile is one row with its cells in ``vals array<double>`` (row-major, north first). Cells are only
shuffled as whole arrays or edge strips, never one row per cell, and no row ever holds more than one
mosaic block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.functions import geometry as geo
from tilespark.functions.arrays import arrays, by_batch, lists, rasters
from tilespark.functions.elevation import bilinear
from tilespark.functions.once import once
from tilespark.functions.tilemath import Grid, affected_range
from tilespark.operators import hot
from tilespark.operators.cache_state import nearest_levels

# a point on a shared edge belongs to both triangles, whatever the rounding
EDGE = 1e-9
SIDES = ("minx", "miny", "maxx", "maxy")


def count_from(start: int, stop: Column | int) -> Column:
    """``start..stop-1`` as an array."""
    stop = F.lit(stop) if isinstance(stop, int) else stop
    return F.sequence(F.lit(start), (stop - 1).cast("int"))


def cell(vals: Column, width: Column | int, col: Column, row: Column) -> Column:
    """One cell, null outside the array."""
    return F.get(vals, (row * width + col).cast("int"))


def mosaic(
    tiles: DataFrame, by: Sequence[str], slot: Column, tiles_w: Column | int, tiles_h: Column | int,
    width: int, height: int, fill: float | None = None, missing: Column | None = None,
) -> DataFrame:
    """Tiles of a block to one raster; slot ``i`` lies at ``(i % tiles_w, i / tiles_w)``.

    A block is a meta tile or the sources of one target tile, so its tiles fit in a row. Missing
    slots keep the fill value, of tiles with one slot any is taken. ``missing`` is an aggregate to keep.
    """
    tiles_w = F.lit(tiles_w) if isinstance(tiles_w, int) else tiles_w
    tiles_h = F.lit(tiles_h) if isinstance(tiles_h, int) else tiles_h
    placed = tiles.withColumn("_slot", slot.cast("int")).withColumn("_tw", tiles_w.cast("int")).withColumn("_th", tiles_h.cast("int"))
    grouped = placed.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("_slot", "vals"))).alias("_all"),
        F.first("_tw").alias("tiles_w"), F.first("_th").alias("tiles_h"), *([] if missing is None else [missing.alias("missing")]))
    alone = F.filter("_all", lambda e, i: (i == 0) | (F.get(F.col("_all"), i - 1)["_slot"] != e["_slot"]))
    grouped = grouped.withColumn("_tiles", F.map_from_entries(alone)).drop("_all")
    blank = F.array_repeat(F.lit(fill).cast("double"), width * height)

    def line(row: Column, at: Column) -> Column:
        return F.flatten(F.transform(count_from(0, F.col("tiles_w")), lambda c: F.slice(
            F.coalesce(F.col("_tiles")[row * F.col("tiles_w") + c], blank), at * width + 1, width)))

    lines = F.transform(count_from(0, F.col("tiles_h") * height), lambda y: line(
        F.floor(y / height).cast("int"), (y % height).cast("int")))
    # later per-cell lookups must find a finished array, not its expression
    return once(grouped, "vals", F.flatten(lines)).withColumn("w", F.col("tiles_w") * width).withColumn(
        "h", F.col("tiles_h") * height).drop("_tiles", "tiles_w", "tiles_h")


def crop(vals: Column, width: Column, height: Column, left: Column, top: Column, out_w: int, out_h: int, fill: float | None = None) -> Column:
    """A window of a raster, filled where it hangs over the edge."""
    filler = F.lit(fill).cast("double")
    lo, hi = F.greatest(left, F.lit(0)), F.least(left + out_w, width)
    before, inside = F.least(F.greatest(-left, F.lit(0)), F.lit(out_w)), F.greatest(hi - lo, F.lit(0))

    def line(i: Column) -> Column:
        y = top + i
        kept = F.slice(vals, (y * width + lo + 1).cast("int"), inside.cast("int"))
        row = F.concat(F.array_repeat(filler, before.cast("int")), kept,
                       F.array_repeat(filler, (F.lit(out_w) - before - inside).cast("int")))
        return F.when((y >= 0) & (y < height) & (inside > 0), row).otherwise(F.array_repeat(filler, out_w))

    return F.flatten(F.transform(count_from(0, out_h), line))


def split(metas: DataFrame, members: Column, tile_w: int, tile_h: int, fill: float | None = None) -> DataFrame:
    """Cut meta rasters into tiles; ``members`` is ``array<struct<x,y,off_x,off_y>>``.

    Members with a negative key are not tiles and are dropped.
    """
    wanted = metas.withColumn("_m", F.explode(F.filter(members, lambda m: (m["x"] >= 0) & (m["y"] >= 0))))
    vals = crop(F.col("vals"), F.col("w"), F.col("h"), F.col("_m.off_x"), F.col("_m.off_y"), tile_w, tile_h, fill)
    return wanted.withColumn("vals", vals).withColumn("x", F.col("_m.x")).withColumn("y", F.col("_m.y")).withColumn(
        "w", F.lit(tile_w)).withColumn("h", F.lit(tile_h)).drop("_m")


def _mean(values: list[Column], nodata: float | None) -> Column:
    """Mean of the valid values, the nodata value (or null) when none is valid."""
    def valid(v):
        return v.isNotNull() if nodata is None else v.isNotNull() & (v != nodata)

    total = sum((F.when(valid(v), v).otherwise(0.0) for v in values[1:]), F.when(valid(values[0]), values[0]).otherwise(0.0))
    n = sum((valid(v).cast("int") for v in values[1:]), valid(values[0]).cast("int"))
    return F.when(n > 0, total / n).otherwise(F.lit(nodata).cast("double"))


def halve(vals: np.ndarray, nodata: float | None = None, method: str = "mean") -> np.ndarray:
    """Half-size raster: each cell from a 2 x 2 block, by the mean of its valid cells or its upper-left cell."""
    if method == "nearest":
        return vals[::2, ::2]
    block = np.stack([vals[dy::2, dx::2] for dy in (0, 1) for dx in (0, 1)])
    valid = ~np.isnan(block) if nodata is None else ~np.isnan(block) & (block != nodata)
    n, total = valid.sum(0), np.where(valid, block, 0.0).sum(0)
    return np.where(n > 0, total / np.maximum(n, 1), np.nan if nodata is None else nodata)


def pyramid(tiles: DataFrame, levels: int, size: int, nodata: float | None = None, method: str = "mean", by: Sequence[str] = ()) -> DataFrame:
    """Overview tiles of the next ``levels`` coarser levels, in one shuffle.

    A tile shrinks to a (size / 2^k)-wide piece of its ancestor k levels up without leaving its row;
    the pieces, a third of the input in all, are grouped by ancestor once. Deeper pyramids run this
    again on the coarsest result. Cells are worked on as arrays, a batch of tiles at a time.
    """
    if size % (1 << levels):
        raise ValueError("a tile must halve evenly on every level")
    keys = tiles.select(*by, "z", "x", "y")

    def shrink(batch: pa.RecordBatch) -> tuple[np.ndarray, dict]:
        at, ks, pieces = [], [], []
        for i, vals in enumerate(arrays(batch.column("vals"))):
            piece = vals.reshape(size, size)
            for k in range(1, levels + 1):
                piece = halve(piece, nodata, method)
                at.append(i)
                ks.append(k)
                pieces.append(piece.ravel())
        return np.array(at, np.int64), {"k": pa.array(ks, pa.int32()), "piece": rasters(pieces)}

    shrunk = by_batch(tiles.select(*keys.columns, "vals"), shrink, keys.schema.fields, "k int, piece array<double>")
    side = F.pow(F.lit(2), F.col("k")).cast("int")
    slot = (F.pmod(F.col("y"), side) * side + F.pmod(F.col("x"), side)).cast("int")
    up = [(F.floor(F.col(c) / side)).cast("long").alias(f"_{c}") for c in "xy"]
    opened = shrunk.select(*by, (F.col("z") - F.col("k")).alias("z"), "k", *up, slot.alias("slot"), "piece")
    grouped = opened.groupBy(*by, "z", F.col("_x").alias("x"), F.col("_y").alias("y"), "k").agg(
        F.collect_list(F.struct("slot", "piece")).alias("_pieces"))

    def assemble(batch: pa.RecordBatch) -> tuple[np.ndarray, dict]:
        out = [_put_together(size, k, pieces, nodata) for k, pieces in zip(batch.column("k").to_pylist(), lists(batch.column("_pieces")), strict=True)]
        return np.arange(len(out)), {"vals": rasters(out)}

    return by_batch(grouped, assemble, grouped.select(*by, "z", "x", "y").schema.fields, "vals array<double>")


def rescale_fill(wanted: DataFrame, stored: DataFrame, size: int, up: int = 0, down: int = 0, nodata: float | None = None) -> DataFrame:
    """``z, x, y, src_z, vals`` of wanted tiles, taken from themselves or the nearest level that has something.

    A part of an ancestor is enlarged, each of its cells to a square; descendants shrink by the mean of their
    valid cells and are put together, gaps staying nodata. Tiles with nothing within ``up`` levels above or
    ``down`` below are left out. A result needs one tile of input however many levels lie between.
    """
    if size % (1 << max(up, down)):
        raise ValueError("a tile must halve evenly on every level")
    keys = stored.select("z", "x", "y").distinct()
    chosen = nearest_levels(wanted.select("z", "x", "y").distinct(), keys, up, down).filter("src_z IS NOT NULL")
    held = stored.select(F.col("z").alias("_z"), F.col("x").alias("_x"), F.col("y").alias("_y"), "vals")
    steps = F.col("z") - F.col("src_z")
    side = F.pow(F.lit(2), F.abs(steps)).cast("long")
    above = chosen.filter("src_z <= z").join(held, (F.col("_z") == F.col("src_z")) & (F.col("_x") == F.floor(F.col("x") / side))
                                             & (F.col("_y") == F.floor(F.col("y") / side)))

    def enlarge(batch: pa.RecordBatch) -> tuple[np.ndarray, dict]:
        out = []
        of = zip(*(batch.column(c).to_pylist() for c in ("z", "src_z", "x", "y")), arrays(batch.column("vals")), strict=True)
        for z, src, x, y, vals in of:
            k = 1 << (z - src)
            n = size // k
            row, col = y % k * n, x % k * n
            part = vals.reshape(size, size)[row:row + n, col:col + n]
            out.append(part.repeat(k, axis=0).repeat(k, axis=1).ravel())
        return np.arange(len(out)), {"_vals": rasters(out)}

    kept = ["z", "x", "y", "src_z"]
    enlarged = by_batch(above.select(*kept, "vals"), enlarge, chosen.select(*kept).schema.fields, "_vals array<double>")

    def shrink(batch: pa.RecordBatch) -> tuple[np.ndarray, dict]:
        out = []
        for steps, vals in zip(batch.column("_k").to_pylist(), arrays(batch.column("vals")), strict=True):
            piece = vals.reshape(size, size)
            for _ in range(steps):
                piece = halve(piece, nodata)
            out.append(piece.ravel())
        return np.arange(len(out)), {"piece": rasters(out)}

    below = chosen.filter("src_z > z").join(held, (F.col("_z") == F.col("src_z")) & (F.floor(F.col("_x") / side) == F.col("x"))
                                            & (F.floor(F.col("_y") / side) == F.col("y")))
    slot = (F.pmod(F.col("_y"), side) * side + F.pmod(F.col("_x"), side)).cast("int")
    below = below.select(*kept, (-steps).cast("int").alias("_k"), slot.alias("slot"), "vals")
    pieces = by_batch(below, shrink, below.drop("vals").schema.fields, "piece array<double>").groupBy(*kept, F.col("_k").alias("k")).agg(
        F.collect_list(F.struct("slot", "piece")).alias("_pieces"))

    def assemble(batch: pa.RecordBatch) -> tuple[np.ndarray, dict]:
        out = [_put_together(size, k, parts, nodata) for k, parts in zip(batch.column("k").to_pylist(), lists(batch.column("_pieces")), strict=True)]
        return np.arange(len(out)), {"_vals": rasters(out)}

    shrunk = by_batch(pieces, assemble, chosen.select(*kept).schema.fields, "_vals array<double>")
    return enlarged.unionByName(shrunk).withColumnRenamed("_vals", "vals")


def _put_together(size: int, k: int, pieces: pa.StructArray, nodata: float | None) -> np.ndarray:
    """One raster from pieces that are ``2^k`` times smaller; nodata where there is none."""
    n, whole = size >> k, np.full((size, size), np.nan if nodata is None else nodata)
    for slot, piece in zip(pieces.field("slot").to_pylist(), arrays(pieces.field("piece")), strict=True):
        row, col = divmod(slot, 1 << k)
        piece = piece.reshape(n, n)
        whole[row * n:(row + 1) * n, col * n:(col + 1) * n] = piece if nodata is None else np.where(np.isnan(piece), nodata, piece)
    return whole.ravel()


def all_blank(tiles: DataFrame, by: Sequence[str], background: float) -> DataFrame:
    """Per group: no tile holds anything but the background."""
    blank = F.forall("vals", lambda v: v.isNull() | (v == background))
    return tiles.groupBy(*by).agg(F.bool_and(blank).alias("all_blank"), F.count(F.lit(1)).alias("n_tiles"))


# ---- borders -----------------------------------------------------------------------------------

# name, neighbour that receives the strip (dx, dy), and the side it lands on there
_STRIPS = (
    ("left", 1, 0), ("right", -1, 0), ("top", 0, 1), ("bottom", 0, -1),
    ("tl", 1, 1), ("tr", -1, 1), ("bl", 1, -1), ("br", -1, -1),
)
BORDER_STRIPS = {"none": (), "unilateral": ("left", "top", "tl"), "bilateral": tuple(s[0] for s in _STRIPS)}


def exchange_borders(tiles: DataFrame, width: int, height: int, mode: str = "bilateral", fill: float | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Add the neighbours' edge cells to each tile: ``left, right, top, bottom`` and corners.

    Tiles and the strips they hand out go through one grouping by target key; strips for absent
    tiles are dropped, and absent neighbours leave the fill value.
    """
    wanted = BORDER_STRIPS[mode]
    vals = F.col("vals")
    column = {0: F.transform(count_from(0, height), lambda i: F.get(vals, i * width)),
              width - 1: F.transform(count_from(0, height), lambda i: F.get(vals, i * width + width - 1))}
    last = (height - 1) * width
    strip = {
        "left": column[width - 1], "right": column[0],
        "top": F.slice(vals, last + 1, width), "bottom": F.slice(vals, 1, width),
        "tl": F.slice(vals, last + width, 1), "tr": F.slice(vals, last + 1, 1),
        "bl": F.slice(vals, width, 1), "br": F.slice(vals, 1, 1),
    }
    empty = F.lit(None).cast("array<double>")
    sent = [F.struct(F.lit("self").alias("role"), F.col("x").alias("x"), F.col("y").alias("y"), vals.alias("cells"))]
    sent += [F.struct(F.lit(n).alias("role"), (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), strip[n].alias("cells"))
             for n, dx, dy in _STRIPS if n in wanted]
    opened = tiles.select(*by, F.explode(F.array(*sent)).alias("s")).select(*by, "s.*")
    got = opened.groupBy(*by, "x", "y").agg(*[
        F.first(F.when(F.col("role") == r, F.col("cells")), ignorenulls=True).alias("vals" if r == "self" else r)
        for r in ("self", *wanted)]).filter(F.col("vals").isNotNull())
    length = {"left": height, "right": height, "top": width, "bottom": width}
    return got.select(*by, "x", "y", "vals", *[
        F.coalesce(F.col(n), F.array_repeat(F.lit(fill).cast("double"), length.get(n, 1)) if n in wanted else empty).alias(n)
        for n in wanted])


def pad(bordered: DataFrame, width: int, height: int, mode: str = "bilateral") -> DataFrame:
    """Assemble bordered tiles into padded rasters (one cell wider per bordered side)."""
    def rows(inner_first: Callable[[Column], list[Column]]):
        return F.flatten(F.transform(count_from(0, height), lambda i: F.concat(*inner_first(i))))

    vals = F.col("vals")
    if mode == "none":
        return bordered.withColumn("w", F.lit(width)).withColumn("h", F.lit(height))
    if mode == "unilateral":
        body = rows(lambda i: [F.slice("left", i + 1, 1), F.slice(vals, i * width + 1, width)])
        padded = F.concat("tl", "top", body)
        return bordered.withColumn("vals", padded).withColumn("w", F.lit(width + 1)).withColumn("h", F.lit(height + 1))
    body = rows(lambda i: [F.slice("left", i + 1, 1), F.slice(vals, i * width + 1, width), F.slice("right", i + 1, 1)])
    padded = F.concat("tl", "top", "tr", body, "bl", "bottom", "br")
    return bordered.withColumn("vals", padded).withColumn("w", F.lit(width + 2)).withColumn("h", F.lit(height + 2))


def geotransform(box: Column, width: Column | int, height: Column | int) -> Column:
    """Origin and cell steps of a tile whose outer samples lie on its edges."""
    w = F.lit(width) if isinstance(width, int) else width
    h = F.lit(height) if isinstance(height, int) else height
    return F.array(box.minx, (box.maxx - box.minx) / (w - 1), F.lit(0.0), box.maxy, F.lit(0.0), -(box.maxy - box.miny) / (h - 1))


# ---- sample grids and sampling -----------------------------------------------------------------

_START = {"none": 0, "unilateral": 0, "bilateral": -1}
_EXTRA = {"none": 0, "unilateral": 1, "bilateral": 1}


def sample_grid(areas: DataFrame, width: int, height: int, mode: Column, terrain: bool = False) -> DataFrame:
    """Sample positions over each area's ``box``: ``col, row_no, x, y``.

    Steps are ``extent / (n - 1)``; terrain samples lie half a step back and never start below row 0.
    """
    def by_mode(table):
        return F.when(mode == "bilateral", table["bilateral"]).when(mode == "unilateral", table["unilateral"]).otherwise(table["none"])

    start, extra = by_mode(_START), by_mode(_EXTRA)
    shift = 0.5 if terrain else 0.0
    box = F.col("box")
    step_x, step_y = (box.maxx - box.minx) / (width - 1), (box.maxy - box.miny) / (height - 1)
    first_row = F.lit(0) if terrain else start
    return (
        areas.withColumn("col", F.explode(F.sequence(start, extra + width - 1)))
        .withColumn("row_no", F.explode(F.sequence(first_row, extra + height - 1)))
        .withColumn("x", box.minx + step_x * (F.col("col") - shift))
        .withColumn("y", box.miny + step_y * (F.col("row_no") - shift))
    )


CORNERS = ("sw", "se", "nw", "ne")


def fill_nodata(corner: dict[str, Column], nodata: float) -> dict[str, Column]:
    """Nodata neighbours take the mean of the valid ones, 0 when none is valid."""
    mean = F.coalesce(_mean([F.when(corner[n] != nodata, corner[n]) for n in CORNERS], None), F.lit(0.0))
    return {n: F.when(corner[n] == nodata, mean).otherwise(corner[n]) for n in CORNERS}


def near_sample(fx: Column, fy: Column) -> Column:
    """Close to a data point on both axes."""
    return ((fx < 0.1) | (fx > 0.9)) & ((fy < 0.1) | (fy > 0.9))


def sample_points(
    points: DataFrame, tiles: DataFrame, point_id: str, px: str, py: str, size: int, total_w: Column, total_h: Column,
    nodata: float, interpolate=bilinear, snap: bool = True, most: int = hot.MOST,
) -> DataFrame:
    """Raster value at fractional pixel positions of a tiled raster.

    A point asks only the one to four tiles its neighbour cells lie in (clamped to the raster), takes
    its cells out of their arrays inside the join, and is put together per point. Cells of absent tiles
    are nodata: they take the mean of the valid neighbours, 0 without any. A tile that more than ``most`` points ask is
    repeated, and its points dealt over the copies.
    """
    x, y = F.col(px), F.col(py)

    def clamp(v, total):
        return F.least(F.greatest(v, F.lit(0)), total - 1).cast("long")

    x0, x1 = clamp(F.floor(x), total_w), clamp(F.ceil(x), total_w)
    y0, y1 = clamp(F.floor(y), total_h), clamp(F.ceil(y), total_h)
    corners = {"nw": (x0, y0), "ne": (x1, y0), "sw": (x0, y1), "se": (x1, y1)}
    spots = [F.struct(F.floor(cx / size).cast("long").alias("x"), F.floor(cy / size).cast("long").alias("y"),
                      ((cy % size) * size + cx % size).cast("int").alias("i")) for cx, cy in corners.values()]
    asked = points.withColumn("_spots", F.array(*spots)).withColumn("_t", F.explode(F.array_distinct(
        F.transform("_spots", lambda s: F.struct(s.x.alias("x"), s.y.alias("y")))))).withColumns({"_x": F.col("_t.x"), "_y": F.col("_t.y")})
    held = tiles.select(F.col("x").alias("_x"), F.col("y").alias("_y"), "vals")
    asked, held = hot.deal_hot(asked, held, ["_x", "_y"], [point_id, px, py], most)
    met = asked.join(held, ["_x", "_y", hot.SALT], "left")
    picks = []
    for i, name in enumerate(corners):
        spot = F.col("_spots")[i]
        here = (spot.x == F.col("_x")) & (spot.y == F.col("_y"))
        picks.append(F.when(here, F.get("vals", spot.i)).alias(f"_{name}"))
    cut = met.select(point_id, px, py, *picks)
    whole = cut.groupBy(point_id, px, py).agg(*[F.coalesce(F.max(f"_{n}"), F.lit(nodata)).alias(f"_{n}") for n in corners])
    filled = fill_nodata({n: F.col(f"_{n}") for n in corners}, nodata)
    named = whole.withColumns({f"_f{n}": c for n, c in filled.items()}).withColumn("_fx", x - F.floor(x)).withColumn("_fy", y - F.floor(y))
    fx, fy = F.col("_fx"), F.col("_fy")
    value = interpolate(*[F.col(f"_f{n}") for n in CORNERS], fx, fy)
    if snap:
        value = F.when(near_sample(fx, fy), F.col("_nw")).otherwise(value)
    return named.select(point_id, px, py, value.alias("value"))


# ---- warping -----------------------------------------------------------------------------------


def source_blocks(targets: DataFrame, sources: DataFrame, dst: Grid, src: Grid, src_level: int, margin: int = 1, most_tiles: int = 1024) -> DataFrame:
    """For each target tile the mosaic of the source tiles under it, and whether any was missing.

    ``targets``: z, x, y; ``sources``: x, y, vals of one source level. Blocks span the tiles a target
    covers plus ``margin`` cells, a few tiles at matching resolutions; a block of more than
    ``most_tiles`` tiles is refused, as it would be one row. A target without any source tile is there, missing.
    """
    size = src.tile_size
    box = dst.tile_bbox(F.col("x"), F.col("y"), F.col("z"))
    level = F.lit(src_level)
    grow = src.resolutions[src_level] * margin
    moved = once(targets, "_b", geo.reproject_bbox(box, dst.srs, src.srs))
    b = F.col("_b")
    ranged = once(moved, "_r", affected_range(src, b.minx - grow, b.miny - grow, b.maxx + grow, b.maxy + grow, level))
    r = F.col("_r")
    n = (r.x1 - r.x0 + 1) * (r.y1 - r.y0 + 1)
    allowed = F.when(n > most_tiles, F.raise_error(F.lit(f"a target covers more than {most_tiles} source tiles: choose a coarser source level"))).otherwise(r.x1)
    one = F.lit(1).cast("long")
    pairs = (
        ranged.withColumn("sx", F.explode_outer(F.sequence(r.x0, allowed))).withColumn("sy", F.explode_outer(F.sequence(r.y0, r.y1)))
        .withColumn("_tw", F.coalesce(r.x1 - r.x0 + 1, one)).withColumn("_th", F.coalesce(r.y1 - r.y0 + 1, one))
        .withColumn("slot", (F.col("sy") - r.y0) * (r.x1 - r.x0 + 1) + F.col("sx") - r.x0)
        .withColumn("x0", r.x0).withColumn("y0", r.y0)
    )
    held = sources.select(F.col("x").alias("sx"), F.col("y").alias("sy"), "vals")
    joined = pairs.join(held.withColumn("_held", F.lit(1)), ["sx", "sy"], "left")
    joined = joined.select("z", "x", "y", "x0", "y0", "_tw", "_th", F.coalesce("slot", F.lit(0).cast("long")).alias("slot"), "vals", "_held")
    return mosaic(joined, ["z", "x", "y", "x0", "y0"], F.col("slot"), F.col("_tw"), F.col("_th"), size, size,
                  missing=F.count("_held") < F.first(F.col("_tw") * F.col("_th")))


def warp(
    blocks: DataFrame, dst: Grid, src: Grid, src_level: int, method: str = "nearest", nodata: float = -9999.0, interpolate=bilinear
) -> DataFrame:
    """Target tiles filled from their source blocks: each cell centre is projected back and looked up.

    ``nearest`` takes the cell holding the position; ``bilinear`` interpolates between cell corners as
    elevation sampling does, treating nodata by the mean of the valid neighbours; ``box`` takes the mean of
    the valid source cells under the target cell. Positions outside the block have no value, and a target off the
    source's grid (null ``x0``) has none at all. ``interpolate`` gets arrays; it may use arithmetic only.
    """
    size, res = dst.tile_size, src.resolutions[src_level]
    left = F.lit(src.bbox[0]) + F.col("x0") * res * src.tile_size
    top = F.lit(src.bbox[3]) - F.col("y0") * res * src.tile_size
    placed = blocks.select("z", "x", "y", "vals", F.col("w").cast("int").alias("w"), left.alias("_left"), top.alias("_top"),
                           dst.tile_bbox(F.col("x"), F.col("y"), F.col("z")).alias("_b")).select("*", "_b.*")
    project = geo.numpy_projection(dst.srs, src.srs)

    def look_up(batch: pa.RecordBatch) -> tuple[np.ndarray, dict]:
        number = {c: batch.column(c).to_pylist() for c in ("w", "_left", "_top", "minx", "maxx", "maxy")}
        out = []
        for i, vals in enumerate(arrays(batch.column("vals"))):
            if number["_left"][i] is None:
                out.append(np.full(size * size, np.nan))
                continue
            grid = vals.reshape(-1, number["w"][i])
            step = (number["maxx"][i] - number["minx"][i]) / size

            def cells(edge: np.ndarray, i=i, step=step) -> tuple[np.ndarray, np.ndarray]:
                x, y = project(number["minx"][i] + edge * step, number["maxy"][i] - edge * step)
                return (x - number["_left"][i]) / res, (number["_top"][i] - y) / res

            # both projections treat the axes apart, so a row and a column of positions are enough
            px, py = cells(np.arange(size) + 0.5)
            if method == "box":
                out.append(_box_means(grid, *cells(np.arange(size + 1.0)), nodata).ravel())
            elif method == "nearest":
                out.append(_pick(grid, np.floor(py), np.floor(px)).ravel())
            else:
                out.append(_between(grid, px, py, nodata, interpolate).ravel())
        return np.arange(len(out)), {"vals": rasters(out)}

    return by_batch(placed, look_up, placed.select("z", "x", "y").schema.fields, "vals array<double>")


def _pick(grid: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Cells at all rows and columns, NaN outside."""
    h, w = grid.shape
    r, c = np.clip(rows, 0, h - 1).astype(np.int64), np.clip(cols, 0, w - 1).astype(np.int64)
    inside = ((rows >= 0) & (rows < h))[:, None] & ((cols >= 0) & (cols < w))[None, :]
    return np.where(inside, grid[r[:, None], c[None, :]], np.nan)


def _between(grid: np.ndarray, px: np.ndarray, py: np.ndarray, nodata: float, interpolate) -> np.ndarray:
    x, y = np.floor(px), np.floor(py)
    right, below = np.minimum(x + 1, grid.shape[1] - 1), np.minimum(y + 1, grid.shape[0] - 1)
    corner = {"nw": _pick(grid, y, x), "ne": _pick(grid, y, right), "sw": _pick(grid, below, x), "se": _pick(grid, below, right)}
    fx, fy = np.broadcast_arrays((px - x)[None, :], (py - y)[:, None])
    raw = corner["nw"]
    valid = {n: (v != nodata) & ~np.isnan(v) for n, v in corner.items()}
    n = sum(valid[c].astype(int) for c in CORNERS)
    mean = sum(np.where(valid[c], corner[c], 0.0) for c in CORNERS) / np.maximum(n, 1)
    whole = [np.where(corner[c] == nodata, mean, corner[c]) for c in CORNERS]
    near = ((fx < 0.1) | (fx > 0.9)) & ((fy < 0.1) | (fy > 0.9))
    return np.where(near, raw, interpolate(*whole, fx, fy))


def _box_means(grid: np.ndarray, px: np.ndarray, py: np.ndarray, nodata: float) -> np.ndarray:
    """Mean of the valid cells whose centres lie between neighbouring positions; at least the nearest cell."""
    valid = ~np.isnan(grid) & (grid != nodata)

    def spans(p: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        lo = np.ceil(p[:-1] - 0.5).astype(np.int64)
        hi = np.ceil(p[1:] - 0.5).astype(np.int64)
        middle = np.floor((p[:-1] + p[1:]) / 2).astype(np.int64)
        lo, hi = np.where(hi > lo, lo, middle), np.where(hi > lo, hi, middle + 1)
        return np.clip(lo, 0, n), np.clip(hi, 0, n)

    (r0, r1), (c0, c1) = spans(py, grid.shape[0]), spans(px, grid.shape[1])

    def sums(v: np.ndarray) -> np.ndarray:
        t = np.zeros((v.shape[0] + 1, v.shape[1] + 1))
        t[1:, 1:] = v.cumsum(0).cumsum(1)
        return t[r1][:, c1] - t[r0][:, c1] - t[r1][:, c0] + t[r0][:, c0]

    n, held = sums(valid.astype(float)), sums(np.ones_like(grid))
    return np.where(held == 0, np.nan, np.where(n > 0, sums(np.where(valid, grid, 0.0)) / np.maximum(n, 1), nodata))


def split_complete(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Targets the source holds in full, and the rejected rest."""
    return blocks.filter(~F.col("missing")), blocks.filter("missing").select("z", "x", "y")


# ---- masks and meshes --------------------------------------------------------------------------


def mask(tiles: DataFrame, width: int, height: int, edges: str = "edges", background: float | None = None) -> DataFrame:
    """Background where a cell's centre lies outside the polygon; whole tiles skip the cell test.

    ``tiles``: box, vals and the polygon's edges (null: no coverage).
    """
    box, e = F.col("box"), F.col(edges)
    outside = np.nan if background is None else background
    classed = once(tiles, "_class", geo.classify_in_edges(e, box))
    blank = F.array_repeat(F.lit(background).cast("double"), width * height)
    plain = classed.withColumn("vals", F.when(F.col("_class") == geo.NONE, blank).otherwise(F.col("vals")))

    def cut(batch: pa.RecordBatch) -> tuple[np.ndarray, dict]:
        out = []
        where = batch.column("box")
        sides = {c: where.field(c).to_pylist() for c in SIDES}
        for i, (state, vals, ring) in enumerate(zip(batch.column("_class").to_pylist(), arrays(batch.column("vals")), lists(batch.column(edges)), strict=True)):
            if state == geo.INTERSECTS:
                minx, miny, maxx, maxy = (sides[c][i] for c in SIDES)
                cx = minx + (np.arange(width) + 0.5) * ((maxx - minx) / width)
                cy = maxy - (np.arange(height) + 0.5) * ((maxy - miny) / height)
                vals = np.where(geo.numpy_inside(ring, cx, cy).ravel(), vals, outside)
            out.append(vals)
        return np.arange(len(out)), {"_vals": rasters(out)}

    kept = by_batch(plain, cut, plain.schema.fields, "_vals array<double>")
    return kept.withColumn("vals", F.col("_vals")).drop("_class", "_vals")


def mesh_sample(points: DataFrame, triangles: DataFrame, point_id: str, x: str, y: str, bucket: float, salts: int = 1) -> DataFrame:
    """Height of the highest triangle above each point.

    ``triangles``: ax, ay, az .. cz. Triangles are listed in every ``bucket``-wide cell their box
    touches and meet points by an equi-join; crowded cells split over ``salts``.
    """
    def lo(axis):
        return F.floor(F.least(*[F.col(f"{v}{axis}") for v in "abc"]) / bucket).cast("long")

    def hi(axis):
        return F.floor(F.greatest(*[F.col(f"{v}{axis}") for v in "abc"]) / bucket).cast("long")

    listed = triangles.withColumn("_bx", F.explode(F.sequence(lo("x"), hi("x")))).withColumn(
        "_by", F.explode(F.sequence(lo("y"), hi("y")))).withColumn("_salt", F.pmod(F.xxhash64("ax", "ay", "bx", "by"), F.lit(salts)))
    asked = points.withColumn("_bx", F.floor(F.col(x) / bucket).cast("long")).withColumn(
        "_by", F.floor(F.col(y) / bucket).cast("long")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return _highest(asked.join(listed, ["_bx", "_by", "_salt"]), point_id, x, y)


def _highest(met: DataFrame, point_id: str, x: str, y: str) -> DataFrame:
    """The highest of the triangles over each point, from pairs of them."""
    c = F.col
    det = (c("by") - c("cy")) * (c("ax") - c("cx")) + (c("cx") - c("bx")) * (c("ay") - c("cy"))
    u = ((c("by") - c("cy")) * (c(x) - c("cx")) + (c("cx") - c("bx")) * (c(y) - c("cy"))) / det
    v = ((c("cy") - c("ay")) * (c(x) - c("cx")) + (c("ax") - c("cx")) * (c(y) - c("cy"))) / det
    w = F.lit(1.0) - u - v
    met = met.filter(det != 0).withColumn(
        "_z", F.when((u >= -EDGE) & (v >= -EDGE) & (w >= -EDGE), u * c("az") + v * c("bz") + w * c("cz")))
    return met.filter(F.col("_z").isNotNull()).groupBy(point_id).agg(F.max("_z").alias("value"))


def mesh_sample_sizes(points: DataFrame, triangles: DataFrame, point_id: str, x: str, y: str, base: float, most: int = 64) -> DataFrame:
    """:func:`mesh_sample` for triangles of all sizes.

    Each triangle lies in the grid of its own size, where cells are at least as wide as it (``base`` times a power of two), so it is
    in four cells at most; a point asks its cell in every grid that has triangles, some dozens at most. Cells of more than ``most``
    triangles deal them over salts, and the points there ask each salt.
    """
    def sides(axis):
        return [F.col(f"{v}{axis}") for v in "abc"]

    spans = [F.greatest(*sides(axis)) - F.least(*sides(axis)) for axis in "xy"]
    grid = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(*spans, F.lit(base)) / base))).cast("int")
    cell_at = lambda v: F.floor(v / (F.pow(F.lit(2.0), F.col("_grid")) * base)).cast("long")
    listed = triangles.withColumn("_grid", grid)
    for name, axis in (("_bx", "x"), ("_by", "y")):
        listed = listed.withColumn(name, F.explode(F.sequence(cell_at(F.least(*sides(axis))), cell_at(F.greatest(*sides(axis))))))
    key = ["_grid", "_bx", "_by"]
    crowded = listed.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(*key, F.ceil(F.col("_n") / most).cast("int").alias("_salts"))
    salt = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*[f"{v}{a}" for v in "abc" for a in "xyz"]), F.col("_salts")).cast("int"))
    listed = listed.join(crowded, key, "left").withColumn("_salt", salt).drop("_salts")
    grids = triangles.select(grid.alias("_grid")).distinct()  # a few dozen: exponents of a double at most
    asked = points.crossJoin(F.broadcast(grids)).withColumn("_bx", cell_at(F.col(x))).withColumn("_by", cell_at(F.col(y)))
    asked = asked.join(crowded, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    met = asked.join(listed, [*key, "_salt"])
    return _highest(met, point_id, x, y)
