"""Layer routing, priorities and request combination."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilespark.functions import formats, geometry as geo
from tilespark.operators import catalog, coverage as cov, routing, tiling
from tilespark.functions.tilemath import GEODETIC
from tilespark.plans.coverage_plans import CUT_TOUCH, GEO_TILES, box_of, cut_coverages, queries_with_extent
from tilespark.plans.inputs import Inputs
from tilespark.plans.registry import plan


def query_res(t: Inputs):
    """Map queries with their resolution in degrees per pixel."""
    q = box_of(t.map_queries)
    return q.withColumn("res", geo.resolution(F.col("box"), F.col("width"), F.col("height")))


RES = "least((maxx-minx)/width, (maxy-miny)/height)"


@plan("resolution_filter", "F3", f"""
WITH q AS (SELECT query_id, layer_key, {RES}*1000e0 AS res FROM map_queries),
l AS (SELECT layer_id, CASE WHEN layer_id%10=0 THEN NULL ELSE min_res END AS min_res, CASE WHEN layer_id%15=0 THEN NULL ELSE max_res END AS max_res FROM upstream_layers)
SELECT query_id, layer_id FROM q JOIN l ON layer_id = layer_key
WHERE (min_res IS NULL OR res <= min_res) AND (max_res IS NULL OR res > max_res)""")
def resolution_filter(t: Inputs):
    layers = t.upstream_layers.select(
        "layer_id", F.when(F.col("layer_id") % 10 != 0, F.col("min_res")).alias("min_res"),
        F.when(F.col("layer_id") % 15 != 0, F.col("max_res")).alias("max_res"))
    q = query_res(t).select("query_id", F.col("layer_key").alias("layer_id"), (F.col("res") * 1000.0).alias("res"))
    return routing.renders(q.join(layers, "layer_id"), F.col("res")).select("query_id", "layer_id")


@plan("zoom_filter", "F4", """
SELECT event_id, p_partkey FROM (SELECT event_id, user_id%21 AS zoom, layer_key FROM layer_requests) e
JOIN part ON p_partkey = layer_key WHERE zoom BETWEEN p_size%10 AND p_size%10 + 6""")
def zoom_filter(t: Inputs):
    layers = t.part.select("p_partkey", (F.col("p_size") % 10).alias("min_zoom"), (F.col("p_size") % 10 + 6).alias("max_zoom"))
    asked = t.layer_requests.select("event_id", (F.col("user_id") % 21).alias("zoom"), F.col("layer_key").alias("p_partkey"))
    return asked.join(layers, "p_partkey").filter(F.col("zoom").between(F.col("min_zoom"), F.col("max_zoom"))).select("event_id", "p_partkey")


@plan("scale_hints", "F3", """
SELECT p_partkey, CASE WHEN p_size%3 = 0 THEN p_size*4e0 WHEN p_size%3 = 1 THEN p_size*4e6*0.00028e0 END AS min_res,
  CASE WHEN p_size%3 = 0 THEN p_size/50e0 WHEN p_size%3 = 1 THEN p_size*1000e0*0.00028e0 END AS max_res FROM part""")
def scale_hints(t: Inputs):
    size = F.col("p_size")
    third = size % 3
    hint = routing.resolution_range(
        F.when(third == 0, size * 4.0), F.when(third == 0, size / 50.0),
        F.when(third == 1, size * 1000.0), F.when(third == 1, size * 4e6))
    return t.part.select("p_partkey", hint.alias("r")).select("p_partkey", "r.min_res", "r.max_res")


OPAQUE = f"""o AS (SELECT query_id, layer_id, transparent, opacity, q.minx AS a, q.miny AS c, q.maxx AS b, q.maxy AS d,
    x.minx, x.miny, x.maxx, x.maxy
  FROM map_queries q JOIN upstream_layers ON layer_id = layer_key JOIN boxes x ON n_nationkey = query_id%25),
f AS (SELECT query_id, layer_id, NOT transparent AND NOT (opacity > 0 AND opacity < 0.99e0)
    AND a >= minx AND b <= maxx AND c >= miny AND d <= maxy AS opaque FROM o)"""


@plan("opaque_layers", "F11", f"WITH {OPAQUE} SELECT query_id, layer_id, opaque FROM f")
def opaque_layers(t: Inputs):
    q = queries_with_extent(t).withColumn("layer_id", F.col("layer_key"))
    covers = geo.bbox_contains(F.col("extent"), F.col("box"))
    return q.join(t.upstream_layers, "layer_id").select("query_id", "layer_id", routing.is_opaque(
        F.lit(True), F.col("transparent"), F.col("opacity"), covers).alias("opaque"))


@plan("route_by_resolution", "J7", f"""
SELECT query_id, CASE WHEN {RES}*1000e0 > min_res/10e0 THEN 'low' ELSE 'high' END AS layer
FROM map_queries JOIN upstream_layers ON layer_id = layer_key""")
def route_by_resolution(t: Inputs):
    q = query_res(t).withColumn("layer_id", F.col("layer_key"))
    return q.join(t.upstream_layers.select("layer_id", "min_res"), "layer_id").select("query_id", routing.route_by_resolution(
        F.col("res") * 1000.0, F.col("min_res") / 10.0, F.lit("low"), F.lit("high")).alias("layer"))


@plan("route_by_srs", "J8", """
WITH l AS (SELECT name, srs, min(layer_id) AS layer_id FROM upstream_layers GROUP BY 1,2),
k AS (SELECT name, arg_min(layer_id, srs) AS first_id, max(layer_id) FILTER (WHERE srs='EPSG:4326') AS geo_id,
      max(layer_id) FILTER (WHERE srs='EPSG:3857') AS merc_id FROM l GROUP BY 1)
SELECT query_id, coalesce(CASE srs WHEN 'EPSG:4326' THEN geo_id WHEN 'EPSG:3857' THEN merc_id END,
       CASE srs WHEN 'EPSG:25832' THEN geo_id END, first_id) AS layer_id
FROM (SELECT query_id, srs, p_brand AS name FROM map_queries JOIN part ON p_partkey = layer_key) q LEFT JOIN k USING (name)""")
def route_by_srs(t: Inputs):
    layers = t.upstream_layers.groupBy("name", "srs").agg(F.min("layer_id").alias("layer_id")).withColumn(
        "ordinal", F.when(F.col("srs") == "EPSG:3857", 0).otherwise(1))
    # systems without a layer of their own prefer lon/lat
    preferred = t.map_queries.filter("srs = 'EPSG:25832'").select(F.col("srs").alias("query_srs")).distinct().select(
        "query_srs", F.lit("EPSG:4326").alias("srs"), F.lit(0).alias("rank"))
    names = t.part.select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("name"))
    q = t.map_queries.select("query_id", "srs", F.col("layer_key").alias("k")).join(names, "k")
    return routing.route_by_srs(q, layers, preferred).select("query_id", "layer_id")


@plan("layer_name_fallback", "J9", """
WITH r AS (SELECT event_id, concat('part', cast(layer_key AS varchar), CASE user_id%3 WHEN 0 THEN '_hd' WHEN 1 THEN '_sd' ELSE '' END) AS name FROM layer_requests),
l AS (SELECT concat('part', cast(p_partkey AS varchar), CASE p_size%2 WHEN 0 THEN '_hd' ELSE '' END, CASE p_partkey%3 WHEN 0 THEN '' WHEN 1 THEN '_EPSG900913' ELSE '_EPSG4326' END) AS layer_name, p_partkey AS layer_id FROM part
  UNION ALL SELECT concat('part', cast(p_partkey AS varchar), '_sd_EPSG4326'), p_partkey + 1000000 FROM part WHERE p_retailprice < 1000)
SELECT event_id, coalesce(a.layer_name, b.layer_name, c.layer_name) AS layer_name, coalesce(a.layer_id, b.layer_id, c.layer_id) AS layer_id
FROM r LEFT JOIN l a ON a.layer_name = name LEFT JOIN l b ON b.layer_name = name || '_EPSG900913' LEFT JOIN l c ON c.layer_name = name || '_EPSG4326'""")
def layer_name_fallback(t: Inputs):
    key, size = F.col("p_partkey"), F.col("p_size")
    base = F.concat(F.lit("part"), key.cast("string"))
    suffix = F.when(key % 3 == 0, "").when(key % 3 == 1, "_EPSG900913").otherwise("_EPSG4326")
    layers = t.part.select(F.concat(base, F.when(size % 2 == 0, "_hd").otherwise(""), suffix).alias("layer_name"), key.alias("layer_id"))
    layers = layers.unionByName(t.part.filter("p_retailprice < 1000").select(
        F.concat(base, F.lit("_sd_EPSG4326")).alias("layer_name"), (key + 1000000).alias("layer_id")))
    asked = t.layer_requests.select(
        "event_id", F.concat(F.lit("part"), F.col("layer_key").cast("string")).alias("layer"),
        F.when(F.col("user_id") % 3 == 0, "hd").when(F.col("user_id") % 3 == 1, "sd").alias("layer_spec"))
    return routing.resolve_layer_names(asked, layers).select("event_id", "layer_name", "layer_id")


SOURCES = f"""
g AS ({GEO_TILES}),
k AS (SELECT DISTINCT cast(floor((lon+180e0)/22.5e0) AS bigint) AS x, cast(floor((lat+90e0)/22.5e0) AS bigint) AS y FROM event_points),
p AS (SELECT k.x, k.y, n_nationkey AS source FROM k JOIN g ON g.z = 4 AND g.x = k.x AND g.y = k.y, boxes
      WHERE {CUT_TOUCH} AND (k.x + n_nationkey)%4 <> 0)"""


def tile_sources(t: Inputs):
    """Level-4 tiles of the points and the nation coverages that can answer them."""
    level = F.lit(4)
    tiles = t.event_points.select(
        level.alias("z"), GEODETIC.tile_x(F.col("lon"), level).alias("x"), GEODETIC.tile_y(F.col("lat"), level).alias("y")).distinct()
    pairs = cov.join_coverages(tiles, cut_coverages(t), GEODETIC, depth=4).select(
        "z", "x", "y", F.col("coverage").alias("source")).withColumn("failed", (F.col("x") + F.col("source")) % 4 == 0)
    return tiles, pairs


@plan("eligible_sources", "J10", f"""
WITH {SOURCES}
SELECT x, y, source, CASE WHEN source IS NULL THEN 'no source' END AS error FROM k LEFT JOIN p USING (x, y)""")
def eligible_sources(t: Inputs):
    tiles, pairs = tile_sources(t)
    return routing.eligible_sources(tiles, pairs, ["z", "x", "y"]).select("x", "y", "source", "error")


@plan("priority_pick", "W2", f"""
WITH {SOURCES} SELECT x, y, arg_min(source, (source%3, source)) AS source FROM p GROUP BY x, y""")
def priority_pick(t: Inputs):
    _, pairs = tile_sources(t)
    usable = pairs.filter(~F.col("failed")).drop("failed").withColumn("priority", F.col("source") % 3)
    return routing.first_by_priority(usable, ["z", "x", "y"], ["priority", "source"]).select("x", "y", "source")


STACK = """st AS (SELECT l_orderkey AS query_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS ord,
  l_partkey AS layer, l_discount, l_returnflag, l_linestatus FROM lineitem)"""


def request_stack(t: Inputs):
    """Layers listed by each request: the lines of an order, at most a handful."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return t.lineitem.select(
        F.col("l_orderkey").alias("query_id"), F.row_number().over(w).cast("long").alias("ord"), F.col("l_partkey").alias("layer"),
        "l_discount", "l_returnflag", "l_linestatus")


@plan("occlusion_cut", "W3", f"""
WITH {STACK}, tp AS (SELECT query_id, max(ord) AS top FROM st WHERE l_discount < 0.025e0 GROUP BY 1)
SELECT query_id, ord, layer FROM st LEFT JOIN tp USING (query_id) WHERE top IS NULL OR ord >= top""")
def occlusion_cut(t: Inputs):
    stack = request_stack(t).withColumn("opaque", F.col("l_discount") < 0.025)
    return routing.cut_hidden(stack, ["query_id"], "ord").select("query_id", "ord", "layer")


@plan("request_combine", "W4", f"""
WITH {STACK},
c AS (SELECT *, l_discount > 0.085e0 AS blocked FROM st),
n AS (SELECT *, CASE WHEN ord = 1 OR blocked OR lag(blocked) OVER w OR l_linestatus IS DISTINCT FROM lag(l_linestatus) OVER w THEN 1 ELSE 0 END AS fresh
      FROM c WINDOW w AS (PARTITION BY query_id ORDER BY ord)),
r AS (SELECT *, cast(sum(fresh) OVER (PARTITION BY query_id ORDER BY ord) AS bigint) AS request_no FROM n)
SELECT query_id, request_no, any_value(l_linestatus) AS url, count(*) AS n_layers, string_agg(cast(layer AS varchar), ',' ORDER BY ord) AS layers FROM r GROUP BY 1,2""")
def request_combine(t: Inputs):
    stack = request_stack(t).withColumn("url", F.col("l_linestatus"))
    merged = routing.combine_requests(stack, ["query_id"], ["ord"], ["url"], F.col("l_discount") > 0.085)
    return merged.select("query_id", "request_no", "url", "n_layers", F.concat_ws(",", F.col("layers").cast("array<string>")).alias("layers"))


@plan("status_policy", "J16", """
SELECT event_id, code, policy, color, cacheable FROM (SELECT event_id, CASE user_id%5 WHEN 0 THEN '404' WHEN 1 THEN '500' WHEN 2 THEN '204' WHEN 3 THEN '502' ELSE '403' END AS code FROM events)
LEFT JOIN (VALUES ('404','404','#ffffff',true), ('500','500','#ff0000',false), ('204','204','#00000000',true), ('502','other','#cccccc',false), ('403','other','#cccccc',false)) p(code, policy, color, cacheable) USING (code)""")
def status_policy(t: Inputs):
    user = F.col("user_id") % 5
    code = F.when(user == 0, "404").when(user == 1, "500").when(user == 2, "204").when(user == 3, "502").otherwise("403")
    policies = t.spark.createDataFrame(
        [("404", "#ffffff", True), ("500", "#ff0000", False), ("204", "#00000000", True), ("other", "#cccccc", False)],
        "code string, color string, cacheable boolean")
    return routing.status_policy(t.events.select("event_id", code.alias("code")), policies)


@plan("layer_ranges_and_extents", "A15", """
WITH l AS (SELECT name, CASE WHEN p_retailprice > 1070 AND layer_id%9=0 THEN NULL ELSE min_res END AS min_res, max_res,
  x.minx, x.miny, x.maxx, x.maxy FROM upstream_layers JOIN boxes x ON n_nationkey = layer_id%25)
SELECT name, CASE WHEN count(*) = count(min_res) THEN max(min_res) END AS min_res, min(max_res) AS max_res,
  min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM l GROUP BY 1""")
def layer_ranges_and_extents(t: Inputs):
    boxes = t.boxes.select("n_nationkey", "minx", "miny", "maxx", "maxy")
    open_ended = (F.col("p_retailprice") > 1070) & (F.col("layer_id") % 9 == 0)
    layers = t.upstream_layers.withColumn("min_res", F.when(~open_ended, F.col("min_res"))).withColumn(
        "n_nationkey", (F.col("layer_id") % 25).cast("int")).join(boxes, "n_nationkey")
    return catalog.merge_resolution_ranges(layers, ["name"]).join(catalog.merge_extents(layers, ["name"]), "name")


@plan("minimal_meta_tile", "A19", """
SELECT user_id, z, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, max(x)-min(x)+1 AS block_w, max(y)-min(y)+1 AS block_h
FROM tile_requests GROUP BY 1,2""")
def minimal_meta_tile(t: Inputs):
    return tiling.minimal_meta(t.tile_requests, ["user_id", "z"])


@plan("dimension_values", "P26", """
SELECT event_id, CASE WHEN user_id%3 = 0 THEN 'd0' ELSE concat('v', cast(user_id AS varchar)) END AS first_value,
  cast(CASE WHEN user_id%3 = 1 THEN 2 ELSE 1 END AS int) AS n_values,
  CASE WHEN user_id%2 = 0 THEN concat('time=', CASE WHEN user_id%3 = 0 THEN 'd0' ELSE concat('v', cast(user_id AS varchar)) END) ELSE '' END AS asked
FROM events""")
def dimension_values(t: Inputs):
    user = F.col("user_id")
    v = F.concat(F.lit("v"), user.cast("string"))
    empty = F.filter(F.array(v), lambda s: F.lit(False))
    values = F.when(user % 3 == 0, empty).when(user % 3 == 1, F.array(v, F.lit("w"))).otherwise(F.array(v))
    df = t.events.select("event_id", values.alias("values"), F.lit("d0").alias("default"),
                         F.create_map(F.when(user % 2 == 0, "TIME").otherwise("STYLE"), F.lit("x")).alias("params"))
    dims = F.create_map(F.lit("time"), F.struct("default", "values"), F.lit("level"), F.struct("default", "values"))
    asked = formats.dimensions_for_params(dims, F.col("params"))
    return df.select(
        "event_id", formats.first_dimension_value(F.col("values"), F.col("default")).alias("first_value"),
        F.size(formats.dimension_values(F.col("values"), F.col("default"))).alias("n_values"),
        F.concat_ws(",", F.transform(F.map_entries(asked), lambda e: F.concat(e.key, F.lit("="), e.value))).alias("asked"))
