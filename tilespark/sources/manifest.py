"""Fetch manifests: one upstream URL per missing tile."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.functions import keys
from tilespark.functions.tilemath import Grid


def bbox_text(grid: Grid, x: Column, y: Column, z: Column) -> Column:
    box = grid.tile_bbox(x, y, z)
    return F.format_string("%.8f,%.8f,%.8f,%.8f", box.minx, box.miny, box.maxx, box.maxy)


def tile_url(
    template: str, grid: Grid, fmt: str, subdomains: Sequence[str] = (), access_token: str | None = None
) -> Column:
    """URL of the tile in columns ``z, x, y``; only placeholders in the template are computed.

    The subdomain follows from the tile key, so a tile keeps its host between runs.
    """
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    fill = {
        "x": lambda: x.cast("string"), "y": lambda: y.cast("string"), "z": lambda: z.cast("string"),
        "format": lambda: F.lit(fmt), "quadkey": lambda: keys.quadkey(x, y, z),
        "tc_path": lambda: keys.tilecache_path(x, y, z), "tms_path": lambda: keys.tms_path(x, y, z),
        "arcgiscache_path": lambda: keys.arcgis_path(x, y, z), "bbox": lambda: bbox_text(grid, x, y, z),
        "access_token": lambda: F.lit(access_token or ""),
        "subdomains": lambda: F.array(*[F.lit(s) for s in subdomains])[
            F.pmod(x + y, F.lit(len(subdomains))).cast("int")],
    }
    if not subdomains:
        fill.pop("subdomains")
    pieces = re.split(r"\{(\w+)\}", template)
    out = []
    for i, piece in enumerate(pieces):
        if i % 2 == 0:
            if piece:
                out.append(F.lit(piece))
        else:
            out.append(fill[piece]() if piece in fill else F.lit("{" + piece + "}"))
    return F.concat(*out)


def fetch_manifest(missing: DataFrame, template: str, grid: Grid, fmt: str, **options) -> DataFrame:
    return missing.withColumn("url", tile_url(template, grid, fmt, **options))
