"""Grids: level tables, tile arithmetic in lon/lat and mercator, level choice."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Web-mercator limits and the defaults a grid falls back to.
MERC_LIMIT = 20037508.342789244
LAT_LIMIT = 85.05112877980659
STRETCH_FACTOR = 1.15
SHRINK_FACTOR = 4.0
TILE_SIZE = 256
NUM_LEVELS = 20
NUM_LEVELS_SQRT2 = 40
METERS_PER_DEGREE = 111319.4907932736
PIXEL_METERS = 0.00028

EDGE_EPS = 1e-9


@dataclass(frozen=True)
class Grid:
    """A tile grid whose level resolutions are known on the driver (a few dozen numbers)."""

    name: str
    srs: str
    bbox: tuple[float, float, float, float]
    resolutions: tuple[float, ...] = field(default=())
    tile_size: int = TILE_SIZE
    origin: str = "nw"
    stretch: float = STRETCH_FACTOR

    @classmethod
    def power_of_two(cls, name, srs, bbox, levels=NUM_LEVELS, tile_size=TILE_SIZE, origin="nw"):
        first = max(bbox[2] - bbox[0], bbox[3] - bbox[1]) / tile_size
        return cls(name, srs, tuple(bbox), tuple(first / 2**z for z in range(levels)), tile_size, origin)

    @property
    def levels(self) -> int:
        return len(self.resolutions)

    @property
    def width(self) -> float:
        return self.bbox[2] - self.bbox[0]

    @property
    def height(self) -> float:
        return self.bbox[3] - self.bbox[1]

    def size(self, z: int) -> tuple[int, int]:
        res = self.resolutions[z]
        return (
            max(math.ceil(math.floor(self.width / res) / self.tile_size), 1),
            max(math.ceil(math.floor(self.height / res) / self.tile_size), 1),
        )

    def resolution(self, z: Column) -> Column:
        """Resolution of a level column: halving grids by arithmetic, others by lookup."""
        first = self.resolutions[0]
        if all(r == first / 2**i for i, r in enumerate(self.resolutions)):
            return F.lit(first) / F.call_function("shiftleft", F.lit(1).cast("long"), z.cast("int"))
        return F.element_at(F.array(*[F.lit(r) for r in self.resolutions]), z.cast("int") + 1)

    def _tiles_along(self, extent: float, z: Column) -> Column:
        pixels = F.floor(F.lit(extent) / self.resolution(z))
        return F.greatest(F.ceil(pixels / self.tile_size), F.lit(1)).cast("long")

    def grid_w(self, z: Column) -> Column:
        return self._tiles_along(self.width, z)

    def grid_h(self, z: Column) -> Column:
        return self._tiles_along(self.height, z)

    def tile_x(self, x: Column, z: Column) -> Column:
        span = self.resolution(z) * self.tile_size
        return F.floor((x - self.bbox[0]) / span).cast("long")

    def tile_y(self, y: Column, z: Column) -> Column:
        span = self.resolution(z) * self.tile_size
        if self.origin in ("nw", "ul"):
            return F.floor((F.lit(self.bbox[3]) - y) / span).cast("long")
        return F.floor((y - self.bbox[1]) / span).cast("long")

    def tile_bbox(self, x: Column, y: Column, z: Column) -> Column:
        span = self.resolution(z) * self.tile_size
        minx = x * span + self.bbox[0]
        if self.origin in ("nw", "ul"):
            maxy = F.lit(self.bbox[3]) - y * span
            miny = F.lit(self.bbox[3]) - (y + 1) * span
        else:
            miny = y * span + self.bbox[1]
            maxy = (y + 1) * span + self.bbox[1]
        return F.struct(
            minx.alias("minx"), miny.alias("miny"),
            ((x + 1) * span + self.bbox[0]).alias("maxx"), maxy.alias("maxy"),
        )

    def closest_level(self, res: Column) -> Column:
        """First level at least as fine as ``res`` within the stretch factor, else the finest."""
        coarser = [(F.lit(r) > res * self.stretch).cast("int") for r in self.resolutions[:-1]]
        return sum(coarser[1:], coarser[0]) if coarser else F.lit(0)

    def first_finer_level(self, res: Column) -> Column:
        """First level strictly finer than ``res``, level 0 when there is none."""
        coarser = [(F.lit(r) >= res).cast("int") for r in self.resolutions]
        level = sum(coarser[1:], coarser[0])
        return F.when(level == self.levels, 0).otherwise(level)


GEODETIC = Grid.power_of_two("GLOBAL_GEODETIC", "EPSG:4326", (-180.0, -90.0, 180.0, 90.0), origin="sw")
MERCATOR = Grid.power_of_two(
    "GLOBAL_MERCATOR", "EPSG:900913", (-MERC_LIMIT, -MERC_LIMIT, MERC_LIMIT, MERC_LIMIT), origin="sw"
)
WEBMERCATOR = Grid.power_of_two(
    "GLOBAL_WEBMERCATOR", "EPSG:3857", (-MERC_LIMIT, -MERC_LIMIT, MERC_LIMIT, MERC_LIMIT), origin="nw"
)
NAMED_GRIDS = {g.name: g for g in (GEODETIC, MERCATOR, WEBMERCATOR)}


def level_factor(factor: Column, z: Column) -> Column:
    """``factor ** z``; the named factor ``sqrt2`` keeps even powers exact."""
    sqrt2 = F.pow(F.lit(2.0), F.floor(z / 2)) * F.when(z % 2 == 1, F.sqrt(F.lit(2.0))).otherwise(1.0)
    return F.when(factor == "sqrt2", sqrt2).otherwise(F.pow(factor.try_cast("double"), z))


def grid_levels(options: DataFrame) -> DataFrame:
    """Explode grid options into one row per level.

    ``options``: grid, minx, miny, maxx, maxy and nullable tile_size, num_levels, res_factor
    (``'sqrt2'`` or a number), min_res, max_res, resolutions (array<double>).
    """
    size = F.coalesce("tile_size", F.lit(TILE_SIZE))
    factor = F.coalesce(F.col("res_factor").cast("string"), F.lit("2"))
    wanted = F.coalesce(
        "num_levels", F.when(factor == "sqrt2", NUM_LEVELS_SQRT2).otherwise(NUM_LEVELS)
    )
    first = F.coalesce(
        "max_res",
        F.greatest((F.col("maxx") - F.col("minx")) / size, (F.col("maxy") - F.col("miny")) / size),
    )
    computed = F.transform(
        F.sequence(F.lit(0), wanted - 1), lambda z: F.col("first_res") / level_factor(F.col("factor"), z)
    )
    kept = F.filter(computed, lambda r: F.col("min_res").isNull() | (r >= F.col("min_res")))
    per_level = (
        options
        .withColumn("size", size).withColumn("factor", factor).withColumn("first_res", first)
        .select(
            "grid", "minx", "miny", "maxx", "maxy", F.col("size").alias("tile_size"),
            F.posexplode(F.coalesce("resolutions", kept)).alias("z", "res"),
        )
    )
    tiles = lambda span: F.greatest(
        F.ceil(F.floor(span / F.col("res")) / F.col("tile_size")), F.lit(1)
    ).cast("long")
    return per_level.select(
        "grid", "z", "res", "tile_size", "minx", "miny", "maxx", "maxy",
        tiles(F.col("maxx") - F.col("minx")).alias("grid_w"),
        tiles(F.col("maxy") - F.col("miny")).alias("grid_h"),
    )


def tile_matrices(levels: DataFrame, geographic: Column, north_first: Column) -> DataFrame:
    """Published tile matrices of a level table (:func:`grid_levels`)."""
    unit = F.when(geographic, METERS_PER_DEGREE).otherwise(1.0)
    left = F.col("minx")
    # the upper-left tile of a grid anchored at its upper-left corner
    top = F.col("maxy")
    return levels.select(
        "grid", F.col("z").cast("string").alias("identifier"),
        (F.col("res") / F.lit(PIXEL_METERS) * unit).alias("scale_denominator"),
        F.when(north_first, top).otherwise(left).alias("top_left_1"),
        F.when(north_first, left).otherwise(top).alias("top_left_2"),
        F.col("tile_size").alias("tile_width"), F.col("tile_size").alias("tile_height"),
        F.col("grid_w").alias("matrix_width"), F.col("grid_h").alias("matrix_height"),
    )


def tiles_per_side(z: Column) -> Column:
    return F.pow(F.lit(2.0), z)


def lonlat_to_tile_x(lon: Column, z: Column) -> Column:
    n = tiles_per_side(z)
    return F.least(F.greatest(F.floor((lon + 180.0) / 360.0 * n), F.lit(0.0)), n - 1).cast("long")


def lonlat_to_tile_y(lat: Column, z: Column) -> Column:
    """Web-mercator row counted from the north; latitudes past the square are clamped."""
    n = tiles_per_side(z)
    rad = F.radians(lat)
    row = F.floor((1.0 - F.log(F.tan(rad) + 1.0 / F.cos(rad)) / F.pi()) / 2.0 * n)
    return F.least(F.greatest(row, F.lit(0.0)), n - 1).cast("long")


def lonlat_to_geodetic_x(lon: Column, z: Column) -> Column:
    n = tiles_per_side(z)
    return F.least(F.greatest(F.floor((lon + 180.0) / 360.0 * n), F.lit(0.0)), n - 1).cast("long")


def lonlat_to_geodetic_y(lat: Column, z: Column) -> Column:
    """Row counted from the south on the square-tiled lon/lat grid (level 0 is one tile wide)."""
    n = tiles_per_side(z)
    top = F.greatest(F.floor(n / 2), F.lit(1.0)) - 1
    return F.least(F.greatest(F.floor((lat + 90.0) / 360.0 * n), F.lit(0.0)), top).cast("long")


def tile_west(x: Column, z: Column) -> Column:
    return x / tiles_per_side(z) * 360.0 - 180.0


def tile_north(y: Column, z: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.pi() * (1.0 - y * 2.0 / tiles_per_side(z)))))


def tile_bounds(x: Column, y: Column, z: Column) -> Column:
    """Lon/lat box of a web-mercator tile."""
    return F.struct(
        tile_west(x, z).alias("minx"), tile_north(y + 1, z).alias("miny"),
        tile_west(x + 1, z).alias("maxx"), tile_north(y, z).alias("maxy"),
    )


def first_index(start: Column, origin: float | Column, span: Column) -> Column:
    """Index of the tile holding the lower edge, with a relative tolerance."""
    return F.floor((start - origin) / span + EDGE_EPS).cast("long")


def last_index(stop: Column, origin: float | Column, span: Column) -> Column:
    """Index of the last tile reached by the upper edge (half-open, relative tolerance)."""
    return (F.ceil((stop - origin) / span - EDGE_EPS) - 1).cast("long")


def affected_range(grid: Grid, minx: Column, miny: Column, maxx: Column, maxy: Column, z: Column) -> Column:
    """``struct<x0,y0,x1,y1>`` of the tiles of level ``z`` a box touches, clamped to the matrix; null off the grid."""
    span = grid.resolution(z) * grid.tile_size
    last_w, last_h = grid.grid_w(z) - 1, grid.grid_h(z) - 1
    zero = F.lit(0).cast("long")
    x0 = first_index(minx, grid.bbox[0], span)
    x1 = last_index(maxx, grid.bbox[0], span)
    if grid.origin in ("nw", "ul"):
        y0 = first_index(-maxy, -grid.bbox[3], span)
        y1 = last_index(-miny, -grid.bbox[3], span)
    else:
        y0 = first_index(miny, grid.bbox[1], span)
        y1 = last_index(maxy, grid.bbox[1], span)
    x1, y1 = F.greatest(x1, x0), F.greatest(y1, y0)
    met = (x0 <= last_w) & (x1 >= 0) & (y0 <= last_h) & (y1 >= 0)
    return F.when(met, F.struct(
        F.greatest(x0, zero).alias("x0"), F.greatest(y0, zero).alias("y0"), F.least(x1, last_w).alias("x1"), F.least(y1, last_h).alias("y1")))


def buffered_bbox(grid: Grid, minx, miny, maxx, maxy, z: Column, pixels: Column) -> Column:
    """Grow a box by whole pixels of a level, never past the grid."""
    grow = F.greatest(pixels, F.lit(0)) * grid.resolution(z)
    has = pixels > 0
    return F.struct(
        F.when(has, F.greatest(minx - grow, F.lit(grid.bbox[0]))).otherwise(minx).alias("minx"),
        F.when(has, F.greatest(miny - grow, F.lit(grid.bbox[1]))).otherwise(miny).alias("miny"),
        F.when(has, F.least(maxx + grow, F.lit(grid.bbox[2]))).otherwise(maxx).alias("maxx"),
        F.when(has, F.least(maxy + grow, F.lit(grid.bbox[3]))).otherwise(maxy).alias("maxy"),
    )


def levels_from_list(levels: Column, num_levels: Column) -> Column:
    return F.filter(levels, lambda z: (z >= 0) & (z < num_levels))


def levels_from_range(start: Column, stop: Column, num_levels: Column) -> Column:
    """Levels ``start..stop``; -1 leaves an end open."""
    lo = F.when(start == -1, 0).otherwise(start)
    hi = F.when(stop == -1, num_levels - 1).otherwise(F.least(stop, num_levels - 1))
    empty = F.array().cast("array<int>")
    return F.when(lo <= hi, F.sequence(lo.cast("int"), F.greatest(hi, lo).cast("int"))).otherwise(empty)


def levels_from_resolution_range(grid: Grid, start: Column, stop: Column) -> Column:
    lo = F.when(start == -1, 0).otherwise(grid.closest_level(start))
    hi = F.when(stop == -1, grid.levels - 1).otherwise(grid.closest_level(stop))
    empty = F.array().cast("array<int>")
    return F.when(lo <= hi, F.sequence(lo.cast("int"), F.greatest(hi, lo).cast("int"))).otherwise(empty)


def levels_from_resolutions(grid: Grid, resolutions: Column) -> Column:
    return F.transform(resolutions, grid.closest_level)
