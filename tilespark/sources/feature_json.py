"""Feature tiles as JSON: ``{layer: FeatureCollection}`` documents to feature rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.functions import geometry as geo

DOCUMENT = (
    "map<string,struct<type:string,features:array<struct<type:string,id:bigint,"
    "geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>>>"
)
# Brackets missing from a geometry's coordinates to the common depth of four.
LIFT = {"Point": 3, "MultiPoint": 2, "LineString": 2, "Polygon": 1, "MultiLineString": 1, "MultiPolygon": 0}


def _by_type(geom_type: Column, make) -> Column:
    out = F
    for name, lift in LIFT.items():
        out = out.when(geom_type == name, make(lift))
    return out.otherwise(F.lit(None))


def coordinates_to_parts(geom_type: Column, text: Column) -> Column:
    """Coordinates of any geometry type as ``array<array<array<struct<x,y>>>>``."""
    lifted = _by_type(geom_type, lambda n: F.concat(F.lit("[" * n), text, F.lit("]" * n)))
    nested = F.from_json(lifted, "array<array<array<array<double>>>>")
    return geo.map_parts(nested, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def parts_to_coordinates(geom_type: Column, parts: Column) -> Column:
    """Coordinates text in the depth of the geometry type."""
    nested = F.to_json(geo.map_parts(parts, lambda p: F.array(p.x, p.y)))
    return _by_type(geom_type, lambda n: F.substring(nested, F.lit(n + 1), F.length(nested) - 2 * n))


def scan_feature_tiles(docs: DataFrame, text: str = "json") -> DataFrame:
    """One row per feature of each document; an empty tile ``{}`` has none."""
    layers = docs.select(*[c for c in docs.columns if c != text], F.explode(F.from_json(text, DOCUMENT)).alias("layer", "_fc"))
    opened = layers.withColumn("_f", F.explode("_fc.features"))
    return opened.select(
        *[c for c in docs.columns if c != text], "layer", F.col("_f.id").alias("fid"), F.col("_f.geometry.type").alias("geom_type"),
        coordinates_to_parts(F.col("_f.geometry.type"), F.col("_f.geometry.coordinates")).alias("parts"),
        F.col("_f.properties").alias("props"))


def _quoted(text: Column) -> Column:
    wrapped = F.to_json(F.array(text))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def feature_tile_documents(features: DataFrame, key=("z", "x", "y"), max_features: int = 50_000) -> DataFrame:
    """One document per tile: columns of ``key``, ``part`` and ``json``.

    A tile with more than ``max_features`` features is spread over numbered part documents, so no
    task assembles an unbounded text; every feature lands in exactly one part.
    """
    key = list(key)
    parts = features.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / max_features).cast("int").alias("_parts"))
    numbered = features.join(parts, key).withColumn("part", F.pmod(F.xxhash64("layer", "fid"), F.col("_parts")).cast("int"))
    text = F.concat(
        F.lit('{"type":"Feature","id":'), F.col("fid").cast("string"), F.lit(',"geometry":{"type":"'), F.col("geom_type"),
        F.lit('","coordinates":'), parts_to_coordinates(F.col("geom_type"), F.col("parts")), F.lit('},"properties":'),
        F.to_json("props"), F.lit("}"))
    collections = numbered.select(*key, "part", "layer", "fid", text.alias("_t")).groupBy(*key, "part", "layer").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("fid", "_t"))), lambda f: f["_t"]), ",").alias("_fs"))
    entry = F.concat(_quoted(F.col("layer")), F.lit(':{"type":"FeatureCollection","features":['), F.col("_fs"), F.lit("]}"))
    return collections.groupBy(*key, "part").agg(
        F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(entry)), ","), F.lit("}")).alias("json"))


def flatten_layers(features: DataFrame) -> DataFrame:
    """One collection: the layer becomes a property unless the feature already has one."""
    tagged = F.when(F.map_contains_key("props", F.lit("layer")), F.col("props")).otherwise(
        F.map_concat("props", F.create_map(F.lit("layer"), F.col("layer"))))
    return features.withColumn("props", tagged).drop("layer")
