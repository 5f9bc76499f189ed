"""Tile directories: scans, metadata scans and exports in the known layouts.

The table of record is Parquet partitioned by tileset and level; loose files are for exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.functions import keys
from tilespark.session import ship_package
from tilespark.sources.storage import put_bytes, qualified

TILE_SCHEMA = "tileset string, z int, x long, y long, format string, data binary, size long, mtime timestamp, cacheable boolean"


def _listed(spark: SparkSession, root: str, layout: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    key = keys.parse_tile_path(layout, F.col("path"))
    return files.withColumn("_key", key)


def unknown_files(spark: SparkSession, root: str, layout: str) -> DataFrame:
    """Files of a directory whose path is no tile of the layout: ``path, size, mtime``. Scans leave them out."""
    found = _listed(spark, root, layout).filter(F.col("_key").isNull())
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def scan_tiles(spark: SparkSession, root: str, layout: str, tileset: str) -> DataFrame:
    """Tiles of a directory with their payload."""
    return _listed(spark, root, layout).filter(F.col("_key").isNotNull()).select(
        F.lit(tileset).alias("tileset"), F.col("_key.z").alias("z"), F.col("_key.x").alias("x"), F.col("_key.y").alias("y"),
        F.col("_key.ext").alias("format"), F.col("content").alias("data"), F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"), F.lit(True).alias("cacheable"))


def scan_metadata(spark: SparkSession, root: str, layout: str, tileset: str) -> DataFrame:
    """Keys, sizes and times only; the payload column is pruned, so files are listed but not read."""
    return scan_tiles(spark, root, layout, tileset).drop("data")


def write_table(tiles: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet table partitioned by tileset and level.

    Rows are spread by key inside a partition, so a level holding a third of all tiles is written by
    many tasks; range-clustering by key keeps neighbouring tiles in one file.
    """
    clustered = tiles.repartitionByRange("tileset", "z", keys.quadkey(F.col("x"), F.col("y"), F.col("z")))
    clustered.write.mode(mode).partitionBy("tileset", "z").parquet(path)


def export_files(tiles: DataFrame, root: str, layout: str) -> int:
    """Write one file per tile below ``root``; returns how many were written. A tile without a path in the
    layout stops the export."""
    path = keys.tile_path(layout, F.col("x"), F.col("y"), F.col("z"), F.col("format"))
    named = tiles.select(F.coalesce(path, F.raise_error(F.lit(f"a tile has no path in layout {layout}")).cast("string")).alias("path"), "data")
    base = qualified(tiles.sparkSession, root)
    ship_package(tiles.sparkSession)

    def write(batches: Iterator) -> Iterator:
        for batch in batches:
            for path, data in zip(batch["path"], batch["data"]):
                put_bytes(f"{base}/{path}", bytes(data))
            yield batch[["path"]].assign(n=1)[["n"]]

    done = named.mapInPandas(write, "n long").agg(F.sum("n").alias("n")).first()
    return int(done["n"] or 0)


def audit_formats(tiles: DataFrame) -> DataFrame:
    """Declared against actual payload format, counted; only the leading bytes are looked at."""
    from tilespark.functions.formats import extension, sniff

    declared = extension(F.col("format"))
    normal = F.when(declared == "jpg", "jpeg").when(declared == "tif", "tiff").otherwise(declared)
    return tiles.select(normal.alias("declared"), sniff(F.col("data")).alias("sniffed")).groupBy("declared", "sniffed").agg(
        F.count(F.lit(1)).alias("tiles"))
