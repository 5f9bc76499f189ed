"""Coverages from text: well-known text, GeoJSON and boxes, brought to one reference system.

A coverage is ``box`` and ``polygon array<array<struct<x,y>>>``. The rings of all polygons are in one
list, as the even-odd rule tells holes from parts. What can't be read gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilespark.functions import geometry as geo
from tilespark.functions.once import bind

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_POINT = rf"\s*{_NUMBER}\s+{_NUMBER}(?:\s+{_NUMBER})*\s*"
_RING = rf"\({_POINT}(?:,{_POINT})*\)"
_POLYGON = rf"\(\s*{_RING}(?:\s*,\s*{_RING})*\s*\)"
_TEXT = rf"(?is)^\s*(?:SRID\s*=\s*\d+\s*;)?\s*(?:POLYGON\s*(?:Z|M|ZM)?\s*{_POLYGON}|MULTIPOLYGON\s*(?:Z|M|ZM)?\s*\(\s*{_POLYGON}(?:\s*,\s*{_POLYGON})*\s*\))\s*$"


def _closed_rings(rings: Column) -> Column:
    """Rings of at least three corners; others enclose nothing."""
    return F.filter(rings, lambda r: F.size(r) >= 3)


def polygon_from_wkt(text: Column) -> Column:
    """Rings of a POLYGON or MULTIPOLYGON; further coordinates of a point are left out."""
    def point(pair: Column) -> Column:
        numbers = F.split(F.trim(pair), r"\s+")
        return geo.vertex(numbers[0].cast("double"), numbers[1].cast("double"))

    rings = F.transform(F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), F.lit(1)), lambda ring: F.transform(F.split(ring, ","), point))
    return F.when(text.rlike(_TEXT), _closed_rings(rings))


def polygon_from_geojson(text: Column) -> Column:
    """Rings of a Polygon or MultiPolygon, of a Feature or of all features of a collection."""
    def rings_of(geometry: Column) -> Column:
        kind, corners = F.get_json_object(geometry, "$.type"), F.get_json_object(geometry, "$.coordinates")
        one = F.from_json(corners, "array<array<array<double>>>")
        many = F.flatten(F.from_json(corners, "array<array<array<array<double>>>>"))
        found = F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many)
        return F.transform(found, lambda ring: F.transform(ring, lambda p: geo.vertex(F.get(p, F.lit(0)), F.get(p, F.lit(1)))))

    features = F.transform(F.from_json(F.get_json_object(text, "$.features"), "array<struct<geometry:string>>"), lambda f: f.geometry)
    single = F.coalesce(F.get_json_object(text, "$.geometry"), text)
    kind = F.get_json_object(text, "$.type")
    geometries = F.when(kind == "FeatureCollection", features).otherwise(F.array(single))
    rings = F.flatten(F.filter(F.transform(geometries, rings_of), lambda r: r.isNotNull()))
    return bind(_closed_rings(rings), lambda r: F.when(F.size(r) > 0, r))


def box_from_text(text: Column) -> Column:
    """``minx,miny,maxx,maxy``."""
    sides = F.transform(F.split(text, ","), lambda v: F.trim(v).try_cast("double"))
    return bind(sides, lambda s: F.when((F.size(s) == 4) & ~F.exists(s, lambda v: v.isNull()), geo.bbox(s[0], s[1], s[2], s[3])))


def polygon_box(polygon: Column) -> Column:
    return bind(polygon, lambda p: F.when(p.isNotNull(), geo.parts_bbox(F.array(p))))


def reproject_polygon(polygon: Column, src: str, dst: str) -> Column:
    return F.transform(polygon, lambda ring: F.transform(ring, lambda p: geo.reproject_xy(p.x, p.y, src, dst)))


# ---- set algebra of predicates -----------------------------------------------------------------


def union_class(parts: list[Column]) -> Column:
    """How a box lies in a union of coverages, from how it lies in each."""
    return F.when(_any(parts, geo.CONTAINS), geo.CONTAINS).when(_any(parts, geo.INTERSECTS), geo.INTERSECTS).otherwise(geo.NONE)


def intersection_class(parts: list[Column]) -> Column:
    return F.when(_any(parts, geo.NONE), geo.NONE).when(_any(parts, geo.INTERSECTS), geo.INTERSECTS).otherwise(geo.CONTAINS)


def difference_class(parts: list[Column]) -> Column:
    """The first without the others. Where only edges meet, the box may still be outside: INTERSECTS."""
    rest = union_class(parts[1:]) if len(parts) > 1 else F.lit(geo.NONE)
    return F.when((parts[0] == geo.NONE) | (rest == geo.CONTAINS), geo.NONE).when(
        (parts[0] == geo.CONTAINS) & (rest == geo.NONE), geo.CONTAINS).otherwise(geo.INTERSECTS)


def _any(parts: list[Column], state: str) -> Column:
    out = parts[0] == state
    for p in parts[1:]:
        out = out | (p == state)
    return out


CLASS_OPERATIONS = {"union": union_class, "intersection": intersection_class, "difference": difference_class}


def expression_class(expression, box: Column) -> Column:
    """Class of a box in a nested expression: ``(operation, part, ...)``, or a coverage's ``(box, edges)`` columns.

    A coverage without edges is its box; ``(None, None)`` contains everything.
    """
    if isinstance(expression[0], str):
        return CLASS_OPERATIONS[expression[0]]([expression_class(e, box) for e in expression[1:]])
    own, edges = expression
    if own is None:
        return F.lit(geo.CONTAINS)
    by_box = geo.bbox_relation(own, box)
    if edges is None:
        return by_box
    return F.when(~geo.bbox_overlaps(own, box), geo.NONE).when(edges.isNull(), by_box).otherwise(geo.classify_in_edges(edges, box))


def expression_holds(expression, x: Column, y: Column) -> Column:
    """Whether a point lies in a nested expression (lower and left edges belong to a box)."""
    if isinstance(expression[0], str):
        parts = [expression_holds(e, x, y) for e in expression[1:]]
        out = parts[0]
        for p in parts[1:]:
            out = {"union": out | p, "intersection": out & p, "difference": out & ~p}[expression[0]]
        return out
    own, edges = expression
    if own is None:
        return F.lit(True)
    inside = (x >= own.minx) & (x < own.maxx) & (y >= own.miny) & (y < own.maxy)
    return inside if edges is None else F.when(edges.isNull(), inside).otherwise(geo.point_in_edges(edges, x, y))
