"""Descriptions of many tilesets at once: statistics with frequent values, availability, layer catalogues.

Nothing here gathers a whole level, attribute or catalogue in one row: counts combine before they are shuffled, and long documents
come in pieces of a bounded size that follow one another.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilespark.functions.once import bind
from tilespark.functions.tilemath import WEBMERCATOR, Grid
from tilespark.operators.catalog import availability, tileset_metadata
from tilespark.operators.ordering import ranked_sort

#: Sides, in tiles, of the squares by which rectangles are listed.
RECT_BLOCK = 64
#: Rectangles in a piece of a document.
PIECE = 1000
#: Hash buckets of an attribute's values.
BUCKETS = 8192


def json_text(value: Column) -> Column:
    """A scalar as JSON."""
    return bind(F.to_json(F.struct(value.alias("v"))), lambda t: F.substring(t, F.lit(6), F.length(t) - 6))


# ---- frequent values and statistics ------------------------------------------------------------


def frequent_values(pairs: DataFrame, by: Sequence[str], value: str, most: int = 100, share: int = 1000, buckets: int = BUCKETS) -> DataFrame:
    """``by, value, count``: the values of each key, exactly counted: all of them if there are at most ``most``; else the (at
    most ``most``) most frequent of those that are at least one in ``share`` of the key's rows, the first in order in a tie.

    The summary is the number of rows per hash bucket, which adds up over tasks and is at most ``buckets`` short rows a
    key. A frequent value lies in a bucket at least as full, and more than ``most`` filled buckets are more than ``most``
    values; so only values in buckets that can matter are shuffled and counted. Null is no value.
    """
    by = list(by)
    rows = pairs.select(*by, F.col(value).alias("value")).filter(F.col("value").isNotNull()).withColumn("_bucket", F.pmod(F.xxhash64("value"), F.lit(buckets)).cast("int"))
    summary = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    totals = summary.groupBy(*by).agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_filled"))
    possible = _met(summary, totals, by).filter((F.col("_filled") <= most) | (F.col("_n") * share >= F.col("_all"))).select(*by, "_bucket", "_all")
    counted = _met(rows, possible, [*by, "_bucket"]).groupBy(*by, "value", "_all").agg(F.count(F.lit(1)).alias("count"))
    kinds = counted.groupBy(*by).agg(F.count(F.lit(1)).alias("_kinds"), F.sum("count").alias("_seen"))
    whole = (F.col("_seen") == F.col("_all")) & (F.col("_kinds") <= most)
    ranked = _met(counted, kinds, by).filter(whole | (F.col("count") * share >= F.col("_all"))).withColumn(
        "_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("count"), "value")))  # at most max(most, share) rows a key
    return ranked.filter(F.col("_rank") <= most).select(*by, "value", "count")


def _met(rows: DataFrame, other: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with what ``other`` has for their key; null is a key like any other."""
    renamed = other.withColumnsRenamed({k: f"_other_{k}" for k in by})
    match = F.lit(True)
    for k in by:
        match = match & F.col(k).eqNullSafe(F.col(f"_other_{k}"))
    return rows.join(renamed, match).drop(*[f"_other_{k}" for k in by])


def attribute_summary(features: DataFrame, by: Sequence[str]) -> DataFrame:
    """Type, number of features and range of each attribute, in one aggregation that combines before the shuffle."""
    by = list(by)
    number = F.col("value").try_cast("double")
    stats = features.select(*by, F.explode("props").alias("attribute", "value")).groupBy(*by, "attribute").agg(
        F.count(F.lit(1)).alias("count"), F.bool_and(number.isNotNull()).alias("_numeric"), F.min(number).alias("_min"), F.max(number).alias("_max"))
    numeric = F.col("_numeric")
    return stats.select(*by, "attribute", F.when(numeric, "Number").otherwise("String").alias("type"), "count",
                        F.when(numeric, F.col("_min")).alias("min"), F.when(numeric, F.col("_max")).alias("max"))


def statistics_documents(features: DataFrame, tileset: str, account: str = "", most_values: int = 100, share: int = 1000) -> DataFrame:
    """``tilesetid, tilestats``: one statistics document per value of the column ``tileset``.

    Attributes list their values, the most frequent first, as :func:`frequent_values` gives them. Bounds are left out for text and
    where they are 0. A row is bounded by layers times attributes times ``most_values``.
    """
    by = [tileset, "layer"]
    pairs = features.select(*by, F.explode("props").alias("attribute", "value"))
    values = frequent_values(pairs, [*by, "attribute"], "value", most_values, share).groupBy(*by, "attribute").agg(
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("n"), "value"))), lambda v: v.value).alias("_values"))
    stats = attribute_summary(features, by).join(values, [*by, "attribute"], "left")
    numeric = F.col("type") == "Number"
    items = F.transform("_values", lambda v: F.when(numeric, v).otherwise(json_text(v)))

    def part(name: str, value: Column, there: Column) -> Column:
        return F.when(there, F.concat(F.lit(f',"{name}":'), value)).otherwise("")

    entry = F.concat(
        F.lit('{"attribute":'), json_text(F.col("attribute")), F.lit(',"type":"'), F.col("type"), F.lit('"'),
        part("values", F.concat(F.lit("["), F.array_join(items, ","), F.lit("]")), F.col("_values").isNotNull()),
        part("min", json_text(F.col("min")), F.coalesce(F.col("min") != 0, F.lit(False))),
        part("max", json_text(F.col("max")), F.coalesce(F.col("max") != 0, F.lit(False))), F.lit("}"))
    attributes = stats.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("attribute", entry.alias("e")))).alias("_a"))
    kinds = features.groupBy(*by, "geom_type").agg(F.count(F.lit(1)).alias("_n"))
    layers = kinds.groupBy(*by).agg(F.sum("_n").alias("count"), F.max_by("geom_type", F.struct("_n", "geom_type")).alias("geometry")).join(attributes, by, "left")
    head = F.concat(F.lit(f'{{"account":"{account}","tilesetid":'), json_text(F.col(tileset)))
    text = F.concat(
        head, F.lit(',"layer":'), json_text(F.col("layer")), F.lit(',"geometry":"'), F.col("geometry"), F.lit('","count":'), F.col("count").cast("string"),
        F.when(F.col("_a").isNotNull(), F.concat(F.lit(',"attributes":['), F.array_join(F.transform("_a", lambda a: a.e), ","), F.lit("]"))).otherwise(""), F.lit("}"))
    whole = layers.withColumn("_text", text).groupBy(tileset).agg(F.sort_array(F.collect_list(F.struct("layer", "_text"))).alias("_l"))
    return whole.select(F.col(tileset).alias("tilesetid"), F.concat(
        head, F.lit(',"layerCount":'), F.size("_l").cast("string"), F.lit(',"layers":['),
        F.array_join(F.transform("_l", lambda e: e._text), ","), F.lit("]}")).alias("tilestats"))


# ---- availability ------------------------------------------------------------------------------


def layer_pieces(tiles: DataFrame, template: str, version: str = "1.0.0", fmt: str = "quantized-mesh-1.0", by: str = "tileset", projection: str = "EPSG:4326",
                 scheme: str = "tms", grid: Grid = WEBMERCATOR, piece: int = PIECE) -> DataFrame:
    """``tileset, z, piece, text``: each tileset's layer description, cut into pieces that follow one another by (z, piece).

    Level -1 is the part before the list of available tiles and the level after the deepest one the part behind it. A level is cut after
    every ``piece`` rectangles, listed by squares of tiles; levels without tiles, down to the deepest that has some, are an empty list.
    """
    rects = availability(tiles, (by, "z"))
    square = F.struct(F.floor(F.col("start_x") / RECT_BLOCK).alias("u"), F.floor(F.col("start_y") / RECT_BLOCK).alias("v"))
    ranked = ranked_sort(rects, [by, "z"], square, ["start_x", "start_y", "end_x", "end_y"], "_rank")
    rect = F.to_json(F.struct(F.col("start_x").alias("startX"), F.col("start_y").alias("startY"), F.col("end_x").alias("endX"), F.col("end_y").alias("endY")))
    parts = ranked.withColumn("piece", F.floor((F.col("_rank") - 1) / piece).cast("long")).groupBy(by, "z", "piece").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_rank", rect.alias("r")))), lambda x: x.r), ",").alias("_list"))
    meta = tileset_metadata(tiles, by=by, grid=grid)
    ends = rects.groupBy(by, "z").agg(F.floor((F.count(F.lit(1)) - 1) / piece).cast("long").alias("_last"))
    levels = meta.select(by, F.explode(F.sequence(F.lit(0), F.col("max_zoom").cast("int"))).alias("z"))
    filled = levels.join(ends, [by, "z"], "left").join(parts, [by, "z"], "left")
    number = F.coalesce("piece", F.lit(0).cast("long"))
    text = F.concat(F.when((F.col("z") > 0) | (number > 0), ",").otherwise(""), F.when(number == 0, "[").otherwise(""), F.coalesce("_list", F.lit("")),
                    F.when(number == F.coalesce("_last", F.lit(0)), "]").otherwise(""))
    body = filled.select(by, F.col("z").cast("int").alias("z"), number.alias("piece"), text.alias("text"))
    zero = F.lit(0).cast("long").alias("piece")
    head = meta.select(by, F.lit(-1).alias("z"), zero, F.concat(
        F.lit('{"name":'), json_text(F.col(by).cast("string")), F.lit(f',"tilejson":"2.1.0","version":"{version}","format":"{fmt}","available":[')).alias("text"))
    bounds = F.array_join(F.transform(F.array("minx", "miny", "maxx", "maxy"), lambda v: F.round(v, 6).cast("string")), ",")
    tail = meta.select(by, (F.col("max_zoom") + 1).cast("int").alias("z"), zero, F.concat(
        F.lit('],"bounds":['), bounds, F.lit('],"minzoom":'), F.col("min_zoom").cast("string"), F.lit(',"maxzoom":'), F.col("max_zoom").cast("string"),
        F.lit(f',"bvhlevels":0,"projection":"{projection}","scheme":"{scheme}","tiles":["{template}"]}}')).alias("text"))
    return head.unionByName(body).unionByName(tail)


# ---- layer catalogues --------------------------------------------------------------------------

#: The lattice of field types: a field that is only one of the first two keeps that type, any other mixture is text.
_BOOLEAN, _NUMBER, _TEXT = 1, 2, 4


def field_type(value: Column) -> Column:
    """The place of a value in the lattice, as a bit; null is no type yet."""
    return F.when(value.isin("true", "false"), _BOOLEAN).when(value.try_cast("double").isNotNull(), _NUMBER).when(value.isNotNull(), _TEXT).otherwise(0)


def layer_catalogue(features: DataFrame, by: Sequence[str] = ("tileset",)) -> DataFrame:
    """``by, layer, fields map, minzoom, maxzoom`` for the layers of many tilesets. Types of a field are joined as bits, before the shuffle."""
    by = list(by)
    pairs = features.select(*by, "layer", F.explode("props").alias("field", "value"))
    bits = pairs.groupBy(*by, "layer", "field").agg(F.bit_or(field_type(F.col("value"))).alias("_bits"))
    named = bits.withColumn("type", F.when(F.col("_bits") == _BOOLEAN, "Boolean").when(F.col("_bits") == _NUMBER, "Number").otherwise("String"))
    fields = named.groupBy(*by, "layer").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "type")))).alias("fields"))
    zooms = features.groupBy(*by, "layer").agg(F.min("z").alias("minzoom"), F.max("z").alias("maxzoom"))
    return zooms.join(fields, [*by, "layer"], "left")


def tilejson_documents(tilesets: DataFrame, catalogue: DataFrame, satellite: str = "mapbox.satellite") -> DataFrame:
    """``id, tilejson`` of every tileset.

    ``tilesets``: id, url, format, minx, miny, maxx, maxy, minzoom, maxzoom and type (null: told from the layers). ``catalogue``: layers by
    ``tileset``. Layers become text first, then a tileset's layers are joined: a row holds one tileset.
    """
    entry = F.to_json(F.struct(F.col("layer").alias("id"), F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("fields"), "minzoom", "maxzoom"))
    layers = catalogue.select(F.col("tileset").alias("_id"), "layer", entry.alias("_entry")).groupBy("_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("layer", "_entry"))), lambda e: e._entry).alias("_layers"))
    met = tilesets.join(layers, F.col("id") == F.col("_id"), "left")
    some = F.coalesce("_layers", F.array().cast("array<string>"))
    kind = F.when(F.size(some) > 0, "vector").otherwise(F.coalesce("type", F.when(F.col("id") == satellite, "raster").otherwise("raster-dem")))

    def numbers(*values: Column) -> Column:
        return F.concat(F.lit("["), F.array_join(F.array(*[F.round(v, 6).cast("string") for v in values]), ","), F.lit("]"))

    text = F.concat(
        F.lit('{"tilejson":"3.0.0","version":"1.0.0","scheme":"xyz","id":'), json_text(F.col("id")), F.lit(',"type":"'), kind, F.lit('","format":'), json_text(F.col("format")),
        F.lit(',"tiles":['), json_text(F.concat(F.col("url"), F.col("id"), F.lit("/{z}/{x}/{y}."), F.col("format"))), F.lit('],"bounds":'),
        numbers(F.col("minx"), F.col("miny"), F.col("maxx"), F.col("maxy")), F.lit(',"center":'),
        numbers((F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2, F.lit(0.0)),
        F.lit(',"minzoom":'), F.least("minzoom", "maxzoom").cast("string"), F.lit(',"maxzoom":'), F.greatest("minzoom", "maxzoom").cast("string"),
        F.lit(',"vector_layers":['), F.array_join(some, ","), F.lit("]}"))
    return met.select("id", text.alias("tilejson"))
