"""Tile keys: quadkeys, directory layouts, origin flips, meta tiles, parents and children."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LAYOUTS = ("tc", "mp", "tms", "reverse_tms", "quadkey", "arcgis")
MAX_ZOOM = 30


def _bit(value: Column, position: Column) -> Column:
    return F.call_function("shiftright", value, position.cast("int")).bitwiseAND(F.lit(1))


def quadkey(x: Column, y: Column, z: Column) -> Column:
    """One base-4 digit per level, coarsest first; level 0 has an empty key."""
    x, y = x.cast("long"), y.cast("long")
    digits = F.transform(
        F.sequence(z.cast("int") - 1, F.lit(0), F.lit(-1)),
        lambda bit: (_bit(x, bit) + _bit(y, bit) * 2).cast("string"),
    )
    return F.when(z <= 0, F.lit("")).otherwise(F.concat_ws("", digits))


def quadkey_x(key: Column) -> Column:
    """Column number of a quadkey: its digits' low bits read as a binary number."""
    return F.coalesce(F.conv(F.translate(key, "0123", "0101"), 2, 10).cast("long"), F.lit(0).cast("long"))


def quadkey_y(key: Column) -> Column:
    return F.coalesce(F.conv(F.translate(key, "0123", "0011"), 2, 10).cast("long"), F.lit(0).cast("long"))


def _div(value: Column, by: int) -> Column:
    return F.floor(value / F.lit(by)).cast("long")


def tilecache_path(x: Column, y: Column, z: Column) -> Column:
    return F.format_string(
        "%02d/%03d/%03d/%03d/%03d/%03d/%03d",
        z, _div(x, 1_000_000), _div(x, 1000) % 1000, x % 1000,
        _div(y, 1_000_000), _div(y, 1000) % 1000, y % 1000,
    )


def tms_path(x: Column, y: Column, z: Column) -> Column:
    return F.format_string("%d/%d/%d", z, x, y)


def arcgis_path(x: Column, y: Column, z: Column) -> Column:
    return F.format_string("L%02d/R%08x/C%08x", z, y, x)


def tile_path(layout: str, x: Column, y: Column, z: Column, ext: Column) -> Column:
    """Path of a tile below its cache folder; null for keys no layout can hold."""
    x, y, z = x.cast("long"), y.cast("long"), z.cast("int")
    stem = {
        "tc": lambda: tilecache_path(x, y, z),
        "mp": lambda: F.format_string(
            "%02d/%04d/%04d/%04d/%04d", z, _div(x, 10_000), x % 10_000, _div(y, 10_000), y % 10_000
        ),
        "tms": lambda: tms_path(x, y, z),
        "reverse_tms": lambda: F.format_string("%d/%d/%d", y, x, z),
        "quadkey": lambda: quadkey(x, y, z),
        "arcgis": lambda: arcgis_path(x, y, z),
    }
    if layout not in stem:
        raise ValueError(f"unknown directory layout {layout!r}")
    return F.when(valid_key(x, y, z), F.concat(stem[layout](), F.lit("."), ext))


def level_dir(layout: str, z: Column) -> Column:
    """Folder holding one level, where the layout has one."""
    if layout in ("tc", "mp", "tms"):
        return F.format_string("%02d", z)
    if layout == "arcgis":
        return F.format_string("L%02d", z)
    raise ValueError(f"layout {layout!r} keeps no level folder")


_PATH_PATTERN = {
    "tc": r"(\d{2,})/(\d{3,})/(\d{3})/(\d{3})/(\d{3,})/(\d{3})/(\d{3})\.(\w+)$",
    "mp": r"(\d{2,})/(\d{4,})/(\d{4})/(\d{4,})/(\d{4})\.(\w+)$",
    "tms": r"(\d+)/(\d+)/(\d+)\.(\w+)$",
    "reverse_tms": r"(\d+)/(\d+)/(\d+)\.(\w+)$",
    "quadkey": r"(?:^|/)([0-3]*)\.(\w+)$",
    "arcgis": r"L(\d{2,})/R([0-9a-f]{8,})/C([0-9a-f]{8,})\.(\w+)$",
}


def parse_tile_path(layout: str, path: Column) -> Column:
    """Inverse of :func:`tile_path`: ``struct<z,x,y,ext>``, null when the path does not fit."""
    if layout not in _PATH_PATTERN:
        raise ValueError(f"unknown directory layout {layout!r}")
    pattern = _PATH_PATTERN[layout]

    def part(i: int) -> Column:
        return F.regexp_extract(path, pattern, i)

    def num(i: int) -> Column:
        return part(i).cast("long")

    def hexa(i: int) -> Column:
        return F.conv(part(i), 16, 10).cast("long")

    z, x, y, ext = {
        "tc": lambda: (num(1), num(2) * 1_000_000 + num(3) * 1000 + num(4),
                       num(5) * 1_000_000 + num(6) * 1000 + num(7), part(8)),
        "mp": lambda: (num(1), num(2) * 10_000 + num(3), num(4) * 10_000 + num(5), part(6)),
        "tms": lambda: (num(1), num(2), num(3), part(4)),
        "reverse_tms": lambda: (num(3), num(2), num(1), part(4)),
        "quadkey": lambda: (F.length(part(1)), quadkey_x(part(1)), quadkey_y(part(1)), part(2)),
        "arcgis": lambda: (num(1), hexa(3), hexa(2), part(4)),
    }[layout]()
    return F.when(
        path.rlike(pattern),
        F.struct(z.cast("int").alias("z"), x.alias("x"), y.alias("y"), ext.alias("ext")),
    )


def valid_key(x: Column, y: Column, z: Column) -> Column:
    return z.between(0, MAX_ZOOM) & (x >= 0) & (y >= 0)


def in_matrix(x: Column, y: Column, grid_w: Column, grid_h: Column) -> Column:
    return (x >= 0) & (y >= 0) & (x < grid_w) & (y < grid_h)


def is_upper_origin(origin: Column) -> Column:
    return origin.isin("ul", "nw")


def flip_row(y: Column, grid_h: Column) -> Column:
    return grid_h - 1 - y


def to_grid_origin(y: Column, grid_h: Column, request_origin: Column, grid_origin: Column) -> Column:
    """Row in the grid's own counting; a request without an origin is taken as is."""
    differs = (
        ((request_origin == "nw") & ~is_upper_origin(grid_origin))
        | ((request_origin == "sw") & is_upper_origin(grid_origin))
    )
    return F.when(F.coalesce(differs, F.lit(False)), flip_row(y, grid_h)).otherwise(y)


def internal_level(z: Column, skip_first: Column, skip_odd: Column, use_profiles: Column) -> Column:
    """Grid level of a published level: global profiles hide level 0, sqrt-2 grids every odd one."""
    shifted = z + F.when(use_profiles & skip_first, 1).otherwise(0)
    return F.when(z >= 0, shifted * F.when(skip_odd, 2).otherwise(1))


def external_level(z: Column, skip_first: Column, skip_odd: Column, use_profiles: Column) -> Column:
    shifted = z - F.when(use_profiles & skip_first, 1).otherwise(0)
    # halves round toward zero, so level -1 of an odd-skipping grid is level 0
    halved = (F.signum(shifted) * F.floor(F.abs(shifted) / 2)).cast("int")
    return F.when(z >= 0, F.when(skip_odd, halved).otherwise(shifted))


def main_tile(value: Column, meta: int | Column) -> Column:
    """First row or column of the meta tile a tile belongs to."""
    return value - F.pmod(value, F.lit(meta) if isinstance(meta, int) else meta)


def parent(value: Column) -> Column:
    return F.shiftright(value, 1)


def ancestor(value: Column, z: Column, at: Column | int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.call_function("shiftright", value.cast("long"), F.greatest(z - at, F.lit(0)).cast("int"))


def children(x: Column, y: Column, z: Column) -> Column:
    return F.array(*[
        F.struct((z + 1).alias("z"), (x * 2 + dx).alias("x"), (y * 2 + dy).alias("y"))
        for dy in (0, 1) for dx in (0, 1)
    ])
