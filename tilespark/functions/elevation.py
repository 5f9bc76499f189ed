"""Elevation packing and interpolation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def bilinear(sw: Column, se: Column, nw: Column, ne: Column, x: Column, y: Column) -> Column:
    """``y`` grows from north to south."""
    return lerp(lerp(nw, sw, y), lerp(ne, se, y), x)


def hyperbolic(sw: Column, se: Column, nw: Column, ne: Column, x: Column, y: Column) -> Column:
    """``y`` grows from south to north."""
    return sw + (se - sw) * x + (nw - sw) * y + (sw - se - nw + ne) * x * y


INTERPOLATORS = {"bilinear": bilinear, "hyperbolic": hyperbolic}


def _bands(packed: Column) -> Column:
    return F.struct(
        F.floor(packed / 65536).cast("int").alias("r"),
        (F.floor(packed / 256) % 256).cast("int").alias("g"),
        (packed % 256).cast("int").alias("b"),
    )


def pack_mapbox(height: Column) -> Column:
    """24-bit RGB, 0.1 m steps above -10000 m."""
    return _bands(F.floor((height + 10000.0) * 10.0 + 0.5).cast("long"))


def unpack_mapbox(r: Column, g: Column, b: Column) -> Column:
    return (r * 65536 + g * 256 + b) / 10.0 - 10000.0


def pack_terrarium(height: Column) -> Column:
    """24-bit RGB, 1/256 m steps above -32768 m."""
    return _bands(F.floor((height + 32768.0) * 256.0).cast("long"))


def unpack_terrarium(r: Column, g: Column, b: Column) -> Column:
    return r * 256.0 + g + b / 256.0 - 32768.0


ENCODINGS = {
    "mapbox": (pack_mapbox, unpack_mapbox),
    "terrarium": (pack_terrarium, unpack_terrarium),
}


def shift_datum(height: Column, offset: Column) -> Column:
    """Height above the ellipsoid from height above a geoid and the local offset."""
    return height + offset
