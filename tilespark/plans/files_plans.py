"""Tile files: directories, containers, payload audits. Tiles are written and read back."""

from __future__ import annotations

import gzip

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tilespark.functions import formats
from tilespark.functions.tilemath import WEBMERCATOR
from tilespark.operators import cache_state as cs
from tilespark.plans.inputs import Inputs
from tilespark.plans.registry import plan
from tilespark.sources import containers, directory
from tilespark.sources.storage import scratch

# one tile per raster row; its payload is the label and id as text
TILES_SQL = "p AS (SELECT cast(16+label%3 AS int) AS z, x, y, concat('tile-', cast(label AS varchar), '-', cast(vec_id AS varchar)) AS text FROM raster_tiles)"


def payload_tiles(t: Inputs):
    text = F.concat(F.lit("tile-"), F.col("label").cast("string"), F.lit("-"), F.col("vec_id").cast("string"))
    return t.raster_tiles.select(
        F.lit("demo").alias("tileset"), (F.col("label") % 3 + 16).alias("z"), "x", "y", F.lit("png").alias("format"),
        F.encode(text, "UTF-8").alias("data"))


@plan("tile_directory_scan", "S1 S2", f"""
WITH {TILES_SQL} SELECT layout, z, x, y, text FROM p, (VALUES ('tc'), ('quadkey'), ('arcgis')) l(layout)""")
def tile_directory_scan(t: Inputs):
    tiles = payload_tiles(t)
    out = None
    for layout in ("tc", "quadkey", "arcgis"):
        root = scratch(t.spark, f"tiles-{layout}")
        directory.export_files(tiles, root, layout)
        found = directory.scan_tiles(t.spark, root, layout, "demo").select(
            F.lit(layout).alias("layout"), "z", "x", "y", F.decode("data", "UTF-8").alias("text"))
        out = found if out is None else out.unionByName(found)
    return out


@plan("tile_metadata_scan", "S3", f"WITH {TILES_SQL} SELECT z, x, y, length(text) AS size, 'png' AS format FROM p")
def tile_metadata_scan(t: Inputs):
    root = scratch(t.spark, "tiles-mp")
    directory.export_files(payload_tiles(t), root, "mp")
    return directory.scan_metadata(t.spark, root, "mp", "demo").select("z", "x", "y", "size", "format")


@plan("tile_table_sink", "S2", """
SELECT tileset, z, count(*) AS tiles, cast(sum(size) AS bigint) AS bytes FROM (
  SELECT tileset, z, x, y, arg_max(size, (mtime, o_orderkey)) AS size FROM tile_store GROUP BY 1,2,3,4) GROUP BY 1,2""")
def tile_table_sink(t: Inputs):
    path = scratch(t.spark, "tile-table")
    directory.write_table(cs.latest(t.tile_store, ("tileset", "z", "x", "y"), ("mtime", "o_orderkey")), path)
    return t.spark.read.parquet(path).groupBy("tileset", "z").agg(F.count(F.lit(1)).alias("tiles"), F.sum("size").alias("bytes"))


@F.pandas_udf(StringType())
def unzipped(data: pd.Series) -> pd.Series:
    return data.map(lambda d: gzip.decompress(bytes(d)).decode())


def _roundtrip(t: Inputs, kind: str):
    root = scratch(t.spark, f"export-{kind}")
    manifest = containers.export_containers(payload_tiles(t), root, kind, "demo", WEBMERCATOR, level=2, max_tiles=100)
    found = containers.read_containers(t.spark, manifest.select(F.col("container").alias("path")))
    return found.select("z", "x", "y", F.decode("data", "UTF-8").alias("text"))


@plan("archive_ingest", "S4 S7", f"WITH {TILES_SQL} SELECT kind, z, x, y, text FROM p, (VALUES ('zip'), ('tar')) k(kind)")
def archive_ingest(t: Inputs):
    parts = [_roundtrip(t, kind).withColumn("kind", F.lit(kind)) for kind in ("zip", "tar")]
    return parts[0].unionByName(parts[1])


@plan("mbtiles_ingest", "S5 S7", f"WITH {TILES_SQL} SELECT z, x, y, text FROM p")
def mbtiles_ingest(t: Inputs):
    return _roundtrip(t, "mbtiles")


@plan("geopackage_ingest", "S6 S7", f"WITH {TILES_SQL} SELECT z, x, y, text, '1F8B' AS gzip_magic FROM p")
def geopackage_ingest(t: Inputs):
    # png payloads stay as stored, which is gzipped, when read back
    root = scratch(t.spark, "export-gpkg")
    manifest = containers.export_containers(payload_tiles(t), root, "gpkg", "demo", WEBMERCATOR, level=2, max_tiles=100)
    found = containers.read_containers(t.spark, manifest.select(F.col("container").alias("path")))
    return found.select("z", "x", "y", F.hex(F.substring("data", 1, 2)).alias("gzip_magic"), unzipped("data").alias("text"))


@plan("export_manifest", "S7 A2", f"""
WITH {TILES_SQL}
SELECT count(*) AS tiles, min(z) AS min_zoom, max(z) AS max_zoom, round(min(x/pow(2e0,z))*360e0-180e0, 6) AS minx FROM p""")
def export_manifest(t: Inputs):
    root = scratch(t.spark, "export-manifest")
    manifest = containers.export_containers(payload_tiles(t), root, "zip", "demo", WEBMERCATOR, level=2, max_tiles=100)
    return manifest.agg(F.sum("tiles").alias("tiles"), F.min("min_zoom").alias("min_zoom"), F.max("max_zoom").alias("max_zoom"),
                        F.round(F.min("minx"), 6).alias("minx"))


@plan("payload_audit", "P23", """
WITH d AS (SELECT event_id%5 AS k, user_id%4 AS f FROM events)
SELECT CASE f WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'webp' ELSE 'tiff' END AS declared,
  CASE k WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'webp' WHEN 3 THEN 'tiff' END AS sniffed, count(*) AS tiles FROM d GROUP BY 1, 2""")
def payload_audit(t: Inputs):
    k, f = F.col("event_id") % 5, F.col("user_id") % 4
    head = F.when(k == 0, "89504E470D0A1A0A0000").when(k == 1, "FFD8FFE000104A464946").when(
        k == 2, "5249464624000000574542505650382000").when(k == 3, "49492A0008000000").otherwise("00112233")
    declared = F.when(f == 0, "image/png").when(f == 1, "jpg").when(f == 2, "image/webp;q=0.8").otherwise("tif")
    return directory.audit_formats(t.events.select(declared.alias("format"), F.unhex(head).alias("data")))


@plan("mime_types", "P23", """
SELECT p_partkey, CASE p_size%6 WHEN 0 THEN 'image/png' WHEN 1 THEN 'application/vnd.mapbox-vector-tile' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'application/x-protobuf'
  WHEN 4 THEN 'application/vnd.quantized-mesh,application/octet-stream;q=1.0' ELSE 'application/json' END AS mime,
  CASE p_size%6 WHEN 0 THEN 'png' WHEN 1 THEN 'mvt' WHEN 2 THEN 'jpeg' WHEN 3 THEN 'pbf' WHEN 4 THEN 'terrain' ELSE 'geojson' END AS extension FROM part""")
def mime_types(t: Inputs):
    k = F.col("p_size") % 6
    fmt = F.when(k == 0, "png").when(k == 1, "mvt").when(k == 2, "jpg").when(k == 3, "omv").when(k == 4, "terrain").otherwise("geojson")
    mime = formats.mime_type(fmt)
    return t.part.select("p_partkey", mime.alias("mime")).withColumn("extension", formats.extension(F.col("mime")))
