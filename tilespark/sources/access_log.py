"""Access logs: tile, TMS, WMTS and WMS requests as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.functions import requests as req
from tilespark.functions.once import once

LOG_SCHEMA = "event_id long, ts timestamp, url string"


def read_access_log(spark: SparkSession, path: str, fmt: str = "json", schema: str = LOG_SCHEMA, stream: bool = False) -> DataFrame:
    """Log files as a batch or a stream; text logs hold one URL per line."""
    reader = (spark.readStream if stream else spark.read).format(fmt)
    if fmt == "text":
        return reader.load(path).withColumnRenamed("value", "url")
    return reader.schema(schema).load(path)


def parse_access_log(log: DataFrame, url: str = "url") -> DataFrame:
    """Add ``family``, tile fields, and box, size and SRS of map requests (WMS, ArcGIS export).

    Tiles asked by keys and values (WMTS) have the family ``wmts_kvp``.

    ``reason`` is null for requests that can be served.
    """
    path = F.substring_index(F.col(url), "?", 1)
    query = F.when(F.instr(F.col(url), "?") > 0, F.substring_index(F.col(url), "?", -1))
    split = once(log.withColumn("_path", path), "_params", req.query_params(query))
    service = F.upper(req.param(F.col("_params"), "service"))
    family = F.coalesce(
        req.url_family(F.col("_path")), F.when(service == "WMS", "wms").when(service == "WMTS", "wmts_kvp"),
        F.when(F.col("_path").rlike("(?i)/export(image)?$") & req.param(F.col("_params"), "bbox").isNotNull(), "arcgis"))
    known = split.withColumn("family", family)
    tiled = once(known, "_tile", req.parse_tile_url(F.col("_path"), F.col("family")))
    params, family = F.col("_params"), F.coalesce("family", F.lit(""))
    is_map, is_key = family.isin("wms", "arcgis"), family == "wmts_kvp"
    keyed = once(tiled, "_key", F.when(is_key, req.param_tile(params)))
    number = {c: F.when(is_key, F.col(f"_key.{c}").cast("int" if c == "z" else "long")).otherwise(F.col(f"_tile.{c}")) for c in "zxy"}
    reason = F.when(is_key, F.when((F.col("_key.x") < 0) | (F.col("_key.y") < 0) | (F.col("_key.z") < 0), "bad number")).when(
        ~is_map, F.col("_tile.reason"))
    srs = F.coalesce(*[req.param(params, n) for n in ("crs", "srs", "bboxsr", "imagesr")])
    return keyed.select(
        *log.columns, "family",
        F.coalesce(F.col("_tile.layer"), F.when(is_map, req.param(params, "layers")), F.when(is_key, req.param(params, "layer"))).alias("layer"),
        F.coalesce(F.col("_tile.layer_spec"), F.when(is_key, req.param(params, "tilematrixset"))).alias("layer_spec"),
        *[number[c].alias(c) for c in "zxy"], F.coalesce(F.col("_tile.format"), F.when(is_map | is_key, req.param(params, "format"))).alias("format"),
        F.when(is_map, req.param_bbox(params)).alias("box"), F.when(is_map, req.param_size(params)).alias("image"),
        F.when(is_map, srs).alias("srs"), reason.alias("reason"))


def quarantine(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Servable requests and refused ones."""
    return parsed.filter("reason IS NULL"), parsed.filter("reason IS NOT NULL")
