"""Vector features as a long table: merging, filtering, retiling, statistics and feature info.

A feature row is ``layer, fid, geom_type, parts array<array<array<struct<x,y>>>>, props map``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilespark.functions import geometry as geo
from tilespark.functions.arrays import by_batch, lists
from tilespark.functions.once import once, once_unless
from tilespark.functions.tilemath import Grid, affected_range
from tilespark.operators.coverage import expand_ranges

POINT_TYPES = ("Point",)


def merge_layers(tiles: Sequence[DataFrame]) -> DataFrame:
    """Bag union of vector tiles; empty features are dropped."""
    merged = tiles[0]
    for more in tiles[1:]:
        merged = merged.unionByName(more)
    return merged.filter(F.col("parts").isNotNull() & (F.size("parts") > 0))


def _cells(rows: DataFrame, grid: Grid, depth: int, box: str) -> DataFrame:
    b = F.col(box)
    level = F.lit(depth)
    ranged = once(rows, "r", affected_range(grid, b.minx, b.miny, b.maxx, b.maxy, level)).withColumn("z", level)
    return expand_ranges(ranged).withColumnsRenamed({"x": "_cx", "y": "_cy"}).drop("z")


def features_in_coverages(features: DataFrame, coverages: DataFrame, grid: Grid, depth: int = 5, salts: int = 1) -> DataFrame:
    """Features with each coverage that keeps them: points inside it, other shapes when their box
    meets it.

    Boxes meet in grid cells; a pair sharing several cells is reported by the cell of the lower-left
    corner of the common box only, so no pair needs deduplication.
    """
    boxed = features.withColumn("_fb", geo.parts_bbox(F.col("parts")))
    salt = F.pmod(F.xxhash64("fid"), F.lit(salts))
    left = _cells(boxed, grid, depth, "_fb").withColumn("_salt", salt)
    prepared = coverages.select("coverage", F.col("box").alias("_cb"), geo.polygon_edges(F.col("polygon")).alias("_edges"))
    right = _cells(prepared, grid, depth, "_cb").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    fb, cb, level = F.col("_fb"), F.col("_cb"), F.lit(depth)
    # the corner of the common box, moved onto the grid like the cells of both
    corner_x, corner_y = (F.greatest(fb[c], cb[c], F.lit(grid.bbox[i])) for i, c in enumerate(("minx", "miny")))
    home = affected_range(grid, corner_x, corner_y, corner_x, corner_y, level)
    met = once(left.join(right, ["_cx", "_cy", "_salt"]), "_home", home)
    at_home = met.filter((F.col("_home.x0") == F.col("_cx")) & (F.col("_home.y0") == F.col("_cy")))
    is_point = F.col("geom_type").isin(*POINT_TYPES)
    overlap = F.when(F.col("_edges").isNull(), geo.bbox_relation(cb, fb)).otherwise(geo.classify_in_edges(F.col("_edges"), fb))
    inside = F.when(F.col("_edges").isNull(), geo.bbox_contains(cb, fb)).otherwise(
        geo.point_in_edges(F.col("_edges"), fb.minx, fb.miny))
    state = F.when(is_point, F.when(inside, geo.CONTAINS).otherwise(geo.NONE)).otherwise(overlap)
    kept = once_unless(at_home, "_state", state, geo.NONE)
    return kept.select(*features.columns, "coverage")


def retile(features: DataFrame, grid: Grid, z: int, src_srs: str, buffer: float = 0.2) -> DataFrame:
    """Features reprojected and keyed by the tiles whose box, widened by ``buffer``, they touch."""
    parts = geo.reproject_parts(F.col("parts"), src_srs, grid.srs)
    moved = once(features, "parts", parts)
    boxed = moved.withColumn("_b", geo.parts_bbox(F.col("parts")))
    grow = grid.resolutions[z] * grid.tile_size * buffer
    b, level = F.col("_b"), F.lit(z)
    ranged = once(boxed, "r", affected_range(grid, b.minx - grow, b.miny - grow, b.maxx + grow, b.maxy + grow, level))
    return expand_ranges(ranged.withColumn("z", level)).drop("_b")


def quantised(features: DataFrame, box: Column, extent: int) -> DataFrame:
    return features.withColumn("parts", geo.map_parts(F.col("parts"), lambda p: geo.quantise(p, box, extent)))


# ---- statistics --------------------------------------------------------------------------------


def attribute_stats(features: DataFrame, by: Sequence[str] = ("layer",)) -> DataFrame:
    """Per layer and attribute: type, number of features and of distinct values, numeric range.

    Values are counted before layers are, so an attribute is never gathered in one place.
    """
    by = list(by)
    values = features.select(*by, F.explode("props").alias("attribute", "value"))
    counted = values.groupBy(*by, "attribute", "value").agg(F.count(F.lit(1)).alias("_n"))
    number = F.col("value").try_cast("double")
    stats = counted.groupBy(*by, "attribute").agg(
        F.sum("_n").alias("count"), F.count("value").alias("n_values"),
        F.bool_and(number.isNotNull()).alias("_numeric"), F.min(number).alias("_min"), F.max(number).alias("_max"))
    numeric = F.col("_numeric")
    return stats.select(
        *by, "attribute", F.when(numeric, "Number").otherwise("String").alias("type"), "count", "n_values",
        F.when(numeric, F.col("_min")).alias("min"), F.when(numeric, F.col("_max")).alias("max"))


def layer_stats(features: DataFrame, by: Sequence[str] = ("layer",)) -> DataFrame:
    """Feature count and dominant geometry type per layer."""
    by = list(by)
    per_type = features.groupBy(*by, "geom_type").agg(F.count(F.lit(1)).alias("_n"))
    return per_type.groupBy(*by).agg(
        F.sum("_n").alias("count"), F.max_by("geom_type", F.struct("_n", "geom_type")).alias("geometry"))


def vector_layers(features: DataFrame) -> DataFrame:
    """Catalogue entry per layer: its fields with their types, and its zoom range."""
    fields = attribute_stats(features).groupBy("layer").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("attribute", "type")))).alias("fields"))
    zooms = features.groupBy("layer").agg(F.min("z").alias("minzoom"), F.max("z").alias("maxzoom"))
    return zooms.join(fields, "layer")


def tile_type(vector_layers: Column, tileset: Column, satellite: str = "mapbox.satellite") -> Column:
    """Type of a tileset that names none: vector with layers, raster for imagery, else elevation."""
    return F.when(vector_layers > 0, "vector").when(tileset == satellite, "raster").otherwise("raster-dem")


def tilejson(catalog: DataFrame, tileset: str, url: str) -> DataFrame:
    """One tile description from a layer catalogue (a few dozen layers)."""
    entry = F.struct(F.col("layer").alias("id"), "fields", "minzoom", "maxzoom")
    whole = catalog.agg(
        F.sort_array(F.collect_list(F.to_json(entry))).alias("_layers"),
        F.min("minzoom").alias("minzoom"), F.max("maxzoom").alias("maxzoom"))
    text = F.concat(
        F.lit('{"tilejson":"3.0.0","version":"1.0.0","scheme":"xyz","id":"' + tileset + '","type":"'),
        tile_type(F.size("_layers"), F.lit(tileset)), F.lit('","tiles":["' + url + '"],"minzoom":'),
        F.col("minzoom").cast("string"), F.lit(',"maxzoom":'), F.col("maxzoom").cast("string"),
        F.lit(',"vector_layers":['), F.array_join("_layers", ","), F.lit("]}"))
    return whole.select(F.lit(tileset).alias("id"), text.alias("tilejson"))


# ---- feature info ------------------------------------------------------------------------------


def top_per_key(rows: DataFrame, by: Sequence[str], order: Sequence[str | Column], k: Column | int) -> DataFrame:
    """First ``k`` rows per key. With a fixed ``k`` every task keeps at most ``k`` rows per key before
    the shuffle, so a crowded key stays cheap."""
    limit = F.lit(k) if isinstance(k, int) else k
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= limit).withColumn(
        "rank", F.col("_rank").cast("long")).drop("_rank")


def feature_info(
    queries: DataFrame, features: DataFrame, radius_px: float, feature_count: int, cell: float, salts: int = 1
) -> DataFrame:
    """Features around the clicked pixel of each query, at most ``feature_count`` of them.

    ``queries``: query_id, box, width, height, pos_x, pos_y and optionally ``guard`` (a box the point
    must lie in). ``features``: fid, layer, x, y. Both meet in ``cell``-wide squares.
    """
    at = geo.pixel_to_coord(F.col("pos_x"), F.col("pos_y"), F.col("width"), F.col("height"), F.col("box"))
    placed = once(queries, "_at", at).withColumn(
        "_tol", geo.resolution(F.col("box"), F.col("width"), F.col("height")) * radius_px)
    x, y, tol = F.col("_at.x"), F.col("_at.y"), F.col("_tol")
    if "guard" in queries.columns:
        g = F.col("guard")
        placed = placed.filter((x >= g.minx) & (x <= g.maxx) & (y >= g.miny) & (y <= g.maxy))

    def square(v):
        return F.floor(v / cell).cast("long")

    asked = placed.withColumn("_cx", F.explode(F.sequence(square(x - tol), square(x + tol)))).withColumn(
        "_cy", F.explode(F.sequence(square(y - tol), square(y + tol)))).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    held = features.select("fid", "layer", F.col("x").alias("_fx"), F.col("y").alias("_fy"), square(F.col("x")).alias("_cx"),
                           square(F.col("y")).alias("_cy"), F.pmod(F.xxhash64("fid"), F.lit(salts)).alias("_salt"))
    hits = asked.join(held, ["_cx", "_cy", "_salt"]).filter(
        (F.abs(F.col("_fx") - x) <= tol) & (F.abs(F.col("_fy") - y) <= tol)).select("query_id", "layer", "fid")
    return top_per_key(hits, ["query_id"], ["layer", "fid"], feature_count)


def combine_text(docs: DataFrame, by: Sequence[str], order: str, text: str) -> DataFrame:
    """Documents of a request joined by line breaks; a request asks a bounded number of layers."""
    return docs.groupBy(*by).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct(order, text))), lambda d: d[text]), "\n").alias("text"))


class _Number(str):
    """A number as it is written in its document."""


def _unique(pairs: list[tuple[str, object]]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a key is there twice")
    return found


def _refused(name: str):
    raise ValueError(f"{name} is no JSON")


def _parsed(text: str | None) -> dict | None:
    """A document's object, or nothing if it is unreadable or no object."""
    try:
        value = json.loads(text, parse_float=_Number, parse_int=_Number, parse_constant=_refused, object_pairs_hook=_unique)
    except (TypeError, ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _written(value) -> str:
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, list):
        return "[" + ",".join(map(_written, value)) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_written(value[k])}" for k in sorted(value)) + "}"
    return json.dumps(value, ensure_ascii=False)


def _folded(objects: list[dict], path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], str]]:
    """Paths and values of merged objects, in document order.

    Scalars give way until the first object or list; from there on only entries of that kind count.
    """
    for key in sorted({k for o in objects for k in o}):
        values, at = [o[key] for o in objects if key in o], (*path, key)
        first = next((i for i, v in enumerate(values) if isinstance(v, (dict, list))), None)
        if first is None:
            yield at, _written(values[-1])
            continue
        live = [v for v in values[first:] if type(v) is type(values[first])]
        if isinstance(live[0], list):
            yield at, _written([e for v in live for e in v])
        elif not any(live):
            yield at, "{}"
        else:
            yield from _folded(live, at)


def combine_json(docs: DataFrame, by: Sequence[str], order: str, text: str) -> DataFrame:
    """Deep merge of the JSON documents of a request, as rows ``path array<string>, value`` (JSON text).

    New keys are added, objects merge, lists append, and a scalar gives way to whatever comes later.
    One shuffle brings a request's documents together, as many as the layers it asks for; each request is
    then merged by itself. Unreadable documents add nothing.
    """
    by = list(by)
    grouped = docs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("_docs"))

    def merge(batch: pa.RecordBatch) -> tuple[np.ndarray, dict]:
        at, paths, values = [], [], []
        for i, found in enumerate(lists(batch.column("_docs"))):
            objects = [o for o in map(_parsed, found.field("t").to_pylist()) if o is not None]
            for path, value in _folded(objects):
                at.append(i)
                paths.append(list(path))
                values.append(value)
        return np.array(at, np.int64), {"path": pa.array(paths, pa.list_(pa.string())), "value": pa.array(values, pa.string())}

    return by_batch(grouped, merge, grouped.select(*by).schema.fields, "path array<string>, value string")
