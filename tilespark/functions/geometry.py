"""Boxes, rings, reprojection and coordinate transforms as Column expressions.

A box is ``struct<minx,miny,maxx,maxy:double>``; a ring is ``array<struct<x,y:double>>``, closed or
not; a polygon is ``array<ring>`` whose later rings are holes; geometry parts are
``array<array<array<struct<x,y>>>>`` for every geometry type.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0

# SRS names whose published axis order is north/east.
AXIS_ORDER_NE = ("EPSG:4326", "EPSG:4258", "EPSG:31466", "EPSG:31467", "EPSG:31468")
GEOGRAPHIC = ("EPSG:4326", "CRS:84")
MERCATOR = ("EPSG:3857", "EPSG:900913")

NONE, INTERSECTS, CONTAINS = "NONE", "INTERSECTS", "CONTAINS"


def bbox(minx, miny, maxx, maxy) -> Column:
    def col(v):
        return v if isinstance(v, Column) else F.lit(float(v))

    return F.struct(
        col(minx).cast("double").alias("minx"), col(miny).cast("double").alias("miny"),
        col(maxx).cast("double").alias("maxx"), col(maxy).cast("double").alias("maxy"),
    )


def bbox_overlaps(a: Column, b: Column) -> Column:
    """Boxes share more than an edge."""
    return (a.minx < b.maxx) & (a.maxx > b.minx) & (a.miny < b.maxy) & (a.maxy > b.miny)


def bbox_contains(outer: Column, inner: Column) -> Column:
    return (
        (inner.minx >= outer.minx) & (inner.maxx <= outer.maxx)
        & (inner.miny >= outer.miny) & (inner.maxy <= outer.maxy)
    )


def bbox_equals(a: Column, b: Column, tol_x: Column, tol_y: Column) -> Column:
    return (
        (F.abs(a.minx - b.minx) <= tol_x) & (F.abs(a.maxx - b.maxx) <= tol_x)
        & (F.abs(a.miny - b.miny) <= tol_y) & (F.abs(a.maxy - b.maxy) <= tol_y)
    )


def bbox_relation(outer: Column, inner: Column) -> Column:
    return (
        F.when(outer.isNull() | bbox_contains(outer, inner), CONTAINS)
        .when(bbox_overlaps(outer, inner), INTERSECTS)
        .otherwise(NONE)
    )


def ring_edges(ring: Column) -> Column:
    """Edges ``struct<p,q>`` of a ring; the closing edge is added (zero length when closed)."""
    shifted = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, shifted, lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def polygon_edges(polygon: Column) -> Column:
    return F.flatten(F.transform(polygon, ring_edges))


def _crosses_ray(edge: Column, x: Column, y: Column) -> Column:
    straddles = (edge.p.y > y) != (edge.q.y > y)
    at = (edge.q.x - edge.p.x) * (y - edge.p.y) / (edge.q.y - edge.p.y) + edge.p.x
    return straddles & (x < at)


def point_in_edges(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over all edges, so holes need no separate treatment."""
    hits = F.aggregate(
        edges, F.lit(0), lambda n, e: n + F.when(_crosses_ray(e, x, y), 1).otherwise(0)
    )
    return hits % 2 == 1


def _edge_enters(edge: Column, box: Column) -> Column:
    """The edge meets the open box: no separating axis among x, y and the edge normal."""
    p, q = edge.p, edge.q
    dx, dy = q.x - p.x, q.y - p.y

    def side(cx: Column, cy: Column) -> Column:
        return dx * (cy - p.y) - dy * (cx - p.x)

    corners = [side(box.minx, box.miny), side(box.maxx, box.miny),
               side(box.maxx, box.maxy), side(box.minx, box.maxy)]
    return (
        (F.least(p.x, q.x) < box.maxx) & (F.greatest(p.x, q.x) > box.minx)
        & (F.least(p.y, q.y) < box.maxy) & (F.greatest(p.y, q.y) > box.miny)
        & (F.least(*corners) < 0) & (F.greatest(*corners) > 0)
    )


def classify_in_edges(edges: Column, box: Column) -> Column:
    middle_x, middle_y = (box.minx + box.maxx) / 2, (box.miny + box.maxy) / 2
    return (
        F.when(edges.isNull(), CONTAINS)
        .when(F.exists(edges, lambda e: _edge_enters(e, box)), INTERSECTS)
        .when(point_in_edges(edges, middle_x, middle_y), CONTAINS)
        .otherwise(NONE)
    )


def classify_in_polygon(polygon: Column, box: Column) -> Column:
    """How a box lies in a polygon; a missing polygon contains everything."""
    return classify_in_edges(polygon_edges(polygon), box)


def vertex(x, y) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def parts_bbox(parts: Column) -> Column:
    """Box around all vertices of a geometry."""
    points = F.flatten(F.flatten(parts))
    xs, ys = F.transform(points, lambda p: p.x), F.transform(points, lambda p: p.y)
    return F.struct(
        F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"),
        F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"),
    )


def swap_axes(srs: Column, box: Column) -> Column:
    """Axis order of north/east systems; an all-zero box is left alone."""
    zero = (box.minx == 0) & (box.miny == 0) & (box.maxx == 0) & (box.maxy == 0)
    return F.when(srs.isin(*AXIS_ORDER_NE) & ~zero, F.struct(
        box.miny.alias("minx"), box.minx.alias("miny"), box.maxy.alias("maxx"), box.maxx.alias("maxy"),
    )).otherwise(box)


#: Latitudes nearer to a pole than this have no place on a mercator map and are moved to it.
POLE = 89.999999


def _to_mercator(x: Column, y: Column) -> Column:
    lat = F.when(y > POLE, POLE).when(y < -POLE, -POLE).otherwise(y)
    return vertex(
        F.radians(x) * EARTH_RADIUS,
        F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * EARTH_RADIUS,
    )


def _to_lonlat(x: Column, y: Column) -> Column:
    return vertex(
        F.degrees(x / EARTH_RADIUS),
        F.degrees(F.atan(F.exp(y / EARTH_RADIUS)) * 2 - math.pi / 2),
    )


def reproject_xy(x: Column, y: Column, src: str, dst: str) -> Column:
    """``struct<x,y>`` in the target system; only lon/lat and spherical mercator are known."""
    known = GEOGRAPHIC + MERCATOR
    if src not in known or dst not in known:
        raise ValueError(f"no projection from {src} to {dst}")
    if (src in MERCATOR) == (dst in MERCATOR):
        return vertex(x, y)
    return _to_mercator(x, y) if dst in MERCATOR else _to_lonlat(x, y)


def numpy_projection(src: str, dst: str):
    """:func:`reproject_xy` for arrays: a function of x and y."""
    known = GEOGRAPHIC + MERCATOR
    if src not in known or dst not in known:
        raise ValueError(f"no projection from {src} to {dst}")
    if (src in MERCATOR) == (dst in MERCATOR):
        return lambda x, y: (x, y)
    if dst in MERCATOR:
        return lambda x, y: (np.radians(x) * EARTH_RADIUS, np.log(np.tan(math.pi / 4 + np.radians(np.clip(y, -POLE, POLE)) / 2)) * EARTH_RADIUS)
    return lambda x, y: (np.degrees(x / EARTH_RADIUS), np.degrees(np.arctan(np.exp(y / EARTH_RADIUS)) * 2 - math.pi / 2))


def numpy_inside(edges, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Even-odd rule for all rows ``y`` and columns ``x``; ``edges`` is an Arrow array of ``struct<p,q>``.

    Each edge is looked at once, for the rows that it spans.
    """
    px, py, qx, qy = (edges.field(a).field(b).to_numpy(zero_copy_only=False) for a in "pq" for b in "xy")
    odd = np.zeros((len(y), len(x)), bool)
    for x0, y0, x1, y1 in zip(px, py, qx, qy, strict=True):
        rows = np.flatnonzero((y0 > y) != (y1 > y))
        if len(rows):
            at = (x1 - x0) * (y[rows] - y0) / (y1 - y0) + x0
            odd[rows] ^= x[None, :] < at[:, None]
    return odd


def reproject_parts(parts: Column, src: str, dst: str) -> Column:
    return F.transform(parts, lambda part: F.transform(
        part, lambda ring: F.transform(ring, lambda p: reproject_xy(p.x, p.y, src, dst))
    ))


def reproject_bbox(box: Column, src: str, dst: str) -> Column:
    """Box around the reprojected edges.

    The known projections are monotone in each axis, so the extremes of a densified edge are its
    ends and two corners suffice.
    """
    lo, hi = reproject_xy(box.minx, box.miny, src, dst), reproject_xy(box.maxx, box.maxy, src, dst)
    return F.struct(lo.x.alias("minx"), lo.y.alias("miny"), hi.x.alias("maxx"), hi.y.alias("maxy"))


def truncate(value: Column) -> Column:
    """Toward zero, as an integer."""
    return value.cast("long")


def pixel_to_coord(px: Column, py: Column, width: Column, height: Column, box: Column) -> Column:
    """Map an image position (rows counted down) to coordinates."""
    return vertex(
        box.minx + px * (box.maxx - box.minx) / width,
        box.miny + (height - py) * (box.maxy - box.miny) / height,
    )


def sub_image(query: Column, width: Column, height: Column, limit: Column) -> Column:
    """Where ``query`` clipped to ``limit`` lies in the query's image: size, offset and box."""
    def px(x):
        return truncate((x - query.minx) * width / (query.maxx - query.minx))

    def py(y):
        return truncate((query.maxy - y) * height / (query.maxy - query.miny))

    left = F.when(limit.minx > query.minx, px(limit.minx)).otherwise(F.lit(0))
    right = F.when(limit.maxx < query.maxx, px(limit.maxx)).otherwise(width)
    bottom = F.when(limit.miny > query.miny, py(limit.miny)).otherwise(height)
    top = F.when(limit.maxy < query.maxy, py(limit.maxy)).otherwise(F.lit(0))
    return F.struct(
        F.abs(right - left).cast("long").alias("width"), F.abs(bottom - top).cast("long").alias("height"),
        left.cast("long").alias("off_x"), top.cast("long").alias("off_y"),
        F.struct(
            F.greatest(query.minx, limit.minx).alias("minx"), F.greatest(query.miny, limit.miny).alias("miny"),
            F.least(query.maxx, limit.maxx).alias("maxx"), F.least(query.maxy, limit.maxy).alias("maxy"),
        ).alias("bbox"),
    )


def tile_offset(src: Column, src_w: Column, src_h: Column, dst: Column) -> Column:
    """Pixel position of a box's upper-left corner inside a source image."""
    return F.struct(
        truncate((dst.minx - src.minx) / (src.maxx - src.minx) * src_w).alias("off_x"),
        truncate((src.maxy - dst.maxy) / (src.maxy - src.miny) * src_h).alias("off_y"),
    )


def round_away(value: Column) -> Column:
    """Nearest integer, halves away from zero."""
    return F.signum(value) * F.floor(F.abs(value) + 0.5)


def quantise(point: Column, box: Column, extent: int) -> Column:
    """Coordinates inside a tile box to integer tile units (rows counted down)."""
    return F.struct(
        round_away((point.x - box.minx) / (box.maxx - box.minx) * extent).cast("smallint").alias("x"),
        round_away((box.maxy - point.y) / (box.maxy - box.miny) * extent).cast("smallint").alias("y"),
    )


def dequantise(qx: Column, qy: Column, x: Column, y: Column, z: Column, extent: int) -> Column:
    """Tile units back to lon/lat, through the inverse mercator projection."""
    size = F.pow(F.lit(2.0), z) * extent
    row = F.lit(180.0) - (qy + y * extent) * 360.0 / size
    return vertex(
        (qx + x * extent) * 360.0 / size - 180.0,
        F.degrees(F.atan(F.exp(F.radians(row)))) * 2 - 90.0,
    )


def map_parts(parts: Column, fn) -> Column:
    """Apply a vertex function to every vertex of a geometry."""
    return F.transform(parts, lambda part: F.transform(part, lambda ring: F.transform(ring, fn)))


def resolution(box: Column, width: Column, height: Column) -> Column:
    return F.least((box.maxx - box.minx) / width, (box.maxy - box.miny) / height)


def in_resolution_range(res: Column, min_res: Column, max_res: Column) -> Column:
    """``min_res`` is the coarsest, ``max_res`` the finest resolution shown; open where null."""
    return (min_res.isNull() | (res <= min_res)) & (max_res.isNull() | (res > max_res))
