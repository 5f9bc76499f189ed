"""Running streams: bounded runs, tile upserts and resumable seeding."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.functions.tilemath import Grid
from tilespark.operators.cache_state import latest, missing
from tilespark.operators.coverage import affected_tiles

KEY = ("tileset", "z", "x", "y")
#: A block of the tile table is ``2^BLOCK_BITS`` tiles wide and high.
BLOCK_BITS = 6


def block_of(x: Column, y: Column, bits: int = BLOCK_BITS) -> Column:
    return F.concat_ws("_", F.shiftright(x, bits), F.shiftright(y, bits))


def stream_parquet(spark: SparkSession, folder: str, pattern: str | None = None, **options) -> DataFrame:
    """Parquet files of a folder as a stream, typed by the files already there."""
    static = spark.read
    stream = spark.readStream
    if pattern:
        static, stream = static.option("pathGlobFilter", pattern), stream.option("pathGlobFilter", pattern)
    for name, value in options.items():
        stream = stream.option(name, value)
    return stream.schema(static.parquet(folder).schema).parquet(folder)


def run_available(rows: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what has arrived into Parquet files, then stop; the checkpoint remembers the rest."""
    rows.writeStream.outputMode(mode).format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_batches(rows: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()


def upsert_tiles(
    updates: DataFrame, table: str, checkpoint: str, order: Sequence[str] = ("mtime",), key: Sequence[str] = KEY, block_bits: int = BLOCK_BITS,
) -> None:
    """Keep the last write of every tile in a Parquet table partitioned by tileset, level and block of tiles.

    A block is ``2^block_bits`` tiles wide and high. Each batch merges with the blocks it touches into a
    staged copy, then replaces only those and drops the copy; a batch that runs again after a failure gives
    the same table.
    """
    spark = updates.sparkSession
    parts = ["tileset", "z", "block"]

    def merge(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("block", block_of(F.col("x"), F.col("y"), block_bits)).persist()
        touched = batch.select(*parts).distinct()
        merged = batch
        if _exists(spark, table):
            stored = spark.read.parquet(table).select(*batch.columns)
            merged = stored.join(touched, parts, "left_semi").unionByName(batch)
        staged = f"{table}-staged-{batch_id}"
        latest(merged, list(key), list(order)).write.mode("overwrite").partitionBy(*parts).parquet(staged)
        spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            *parts).parquet(table)
        batch.unpersist()
        _drop(spark, staged)

    run_batches(updates, merge, checkpoint)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there at all; a damaged table is an error, not an empty one."""
    place = _place(spark, path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _drop(spark: SparkSession, path: str) -> None:
    place = _place(spark, path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def _place(spark: SparkSession, path: str):
    from tilespark.sources.storage import qualified

    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(qualified(spark, path))


def seed(tasks: DataFrame, stored: DataFrame, grid: Grid, path: str, checkpoint: str) -> None:
    """Stream seed tasks (task, box, z) to the tiles that still need creating.

    Tasks already listed in the checkpoint are not walked again, so an interrupted run resumes.
    """
    wanted = affected_tiles(tasks, grid, spread=True).select("task", "z", "x", "y")
    run_available(missing(wanted, stored), path, checkpoint)
