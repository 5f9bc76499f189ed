"""Vector features: JSON tiles, quantising, spatial filters, retiling, statistics, feature info."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilespark.functions import geometry as geo
from tilespark.functions.tilemath import GEODETIC, WEBMERCATOR, lonlat_to_tile_x, lonlat_to_tile_y, tile_bounds
from tilespark.operators import vector
from tilespark.plans.coverage_plans import box_of, cut_coverages
from tilespark.plans.inputs import Inputs, merc_x, merc_y
from tilespark.plans.registry import plan
from tilespark.sources import feature_json

# customers are points of their segment's layer, suppliers two-vertex lines
FEATURES = f"""feat AS (
  SELECT segment AS layer, id AS fid, 'Point' AS geom_type, lon, lat, cast(floor(acctbal) AS bigint) AS bal, cast(NULL AS varchar) AS own, cast(6 AS int) AS z,
    {merc_x('lon', '64e0')} AS x, {merc_y('lat', '64e0')} AS y FROM customer_points
  UNION ALL SELECT 'supplier', id, 'LineString', lon, lat, cast(floor(acctbal) AS bigint), CASE WHEN nation%3=0 THEN 'own' END, cast(5 AS int),
    {merc_x('lon', '32e0')}, {merc_y('lat', '32e0')} FROM supplier_points)"""


def features(t: Inputs):
    lon, lat = F.col("lon"), F.col("lat")
    bal = F.floor("acctbal").cast("long").cast("string")
    six, five = F.lit(6), F.lit(5)
    points = t.customer_points.select(
        F.col("segment").alias("layer"), F.col("id").alias("fid"), F.lit("Point").alias("geom_type"),
        F.array(F.array(F.array(geo.vertex(lon, lat)))).alias("parts"),
        F.create_map(F.lit("balance"), bal, F.lit("segment"), F.col("segment")).alias("props"), six.alias("z"),
        lonlat_to_tile_x(lon, six).alias("x"), lonlat_to_tile_y(lat, six).alias("y"))
    base = F.create_map(F.lit("balance"), bal)
    props = F.when(F.col("nation") % 3 == 0, F.map_concat(base, F.create_map(F.lit("layer"), F.lit("own")))).otherwise(base)
    lines = t.supplier_points.select(
        F.lit("supplier").alias("layer"), F.col("id").alias("fid"), F.lit("LineString").alias("geom_type"),
        F.array(F.array(F.array(geo.vertex(lon, lat), geo.vertex(lon + 1, lat + 1)))).alias("parts"), props.alias("props"),
        five.alias("z"), lonlat_to_tile_x(lon, five).alias("x"), lonlat_to_tile_y(lat, five).alias("y"))
    return points.unionByName(lines)


@plan("feature_json_tiles", "S8", f"""
WITH {FEATURES}
SELECT z, x, y, layer, fid, geom_type, CASE geom_type WHEN 'Point' THEN 1 ELSE 2 END AS n_vertices, round(lon, 6) AS px, round(lat, 6) AS py,
  cast(bal AS varchar) AS balance FROM feat""")
def feature_json_tiles(t: Inputs):
    # written as documents and read back
    docs = feature_json.feature_tile_documents(features(t), max_features=500)
    rows = feature_json.scan_feature_tiles(docs)
    first = F.col("parts")[0][0][0]
    return rows.select("z", "x", "y", "layer", "fid", "geom_type", F.size(F.col("parts")[0][0]).alias("n_vertices"),
                       F.round(first.x, 6).alias("px"), F.round(first.y, 6).alias("py"), F.col("props")["balance"].alias("balance"))


@plan("flatten_layers", "S9", f"""
WITH {FEATURES} SELECT fid, geom_type, coalesce(own, layer) AS layer, CASE WHEN own IS NULL AND geom_type='LineString' THEN 2 WHEN own IS NULL THEN 3 ELSE 2 END AS n_props FROM feat""")
def flatten_layers(t: Inputs):
    flat = feature_json.flatten_layers(features(t))
    return flat.select("fid", "geom_type", F.col("props")["layer"].alias("layer"), F.size("props").alias("n_props"))


@plan("quantise_coords", "P19", f"""
WITH q AS (SELECT event_id, lon, lat, x, y FROM (SELECT event_id, lon, lat, {merc_x('lon','16e0')} AS x, {merc_y('lat','16e0')} AS y FROM event_points)),
b AS (SELECT *, x/16e0*360e0-180e0 AS minx, (x+1)/16e0*360e0-180e0 AS maxx, degrees(atan(sinh(pi()*(1e0-(y+1)*2e0/16e0)))) AS miny, degrees(atan(sinh(pi()*(1e0-y*2e0/16e0)))) AS maxy FROM q),
k AS (SELECT *, round((lon-minx)/(maxx-minx)*4096e0) AS qx, round((maxy-lat)/(maxy-miny)*4096e0) AS qy FROM b)
SELECT event_id, cast(qx AS smallint) AS qx, cast(qy AS smallint) AS qy,
  round((qx+x*4096e0)*360e0/65536e0-180e0, 6) AS lon, round(degrees(2e0*atan(exp(radians(180e0-(qy+y*4096e0)*360e0/65536e0))))-90e0, 6) AS lat FROM k""")
def quantise_coords(t: Inputs):
    four = F.lit(4)
    lon, lat = F.col("lon"), F.col("lat")
    tiled = t.event_points.withColumn("x", lonlat_to_tile_x(lon, four)).withColumn("y", lonlat_to_tile_y(lat, four))
    tiled = tiled.withColumn("box", tile_bounds(F.col("x"), F.col("y"), four)).withColumn(
        "parts", F.array(F.array(F.array(geo.vertex(lon, lat)))))
    q = vector.quantised(tiled, F.col("box"), 4096).withColumn("q", F.col("parts")[0][0][0])
    back = geo.dequantise(F.col("q.x"), F.col("q.y"), F.col("x"), F.col("y"), four, 4096)
    return q.select("event_id", F.col("q.x").alias("qx"), F.col("q.y").alias("qy"), F.round(back.x, 6).alias("lon"), F.round(back.y, 6).alias("lat"))


SHAPES = """shp AS (SELECT event_id AS fid, event_id%3 AS k, lon AS a, lat AS c, CASE event_id%3 WHEN 0 THEN lon ELSE lon+3e0 END AS b,
  CASE event_id%3 WHEN 0 THEN lat WHEN 1 THEN lat+2e0 ELSE lat+4e0 END AS d FROM event_points)"""


def shapes(t: Inputs):
    lon, lat, k = F.col("lon"), F.col("lat"), F.col("event_id") % 3
    ring = F.when(k == 0, F.array(geo.vertex(lon, lat))).when(k == 1, F.array(geo.vertex(lon, lat), geo.vertex(lon + 3, lat + 2))).otherwise(
        F.array(geo.vertex(lon, lat), geo.vertex(lon + 3, lat), geo.vertex(lon, lat + 4)))
    kind = F.when(k == 0, "Point").when(k == 1, "LineString").otherwise("Polygon")
    return t.event_points.select(F.lit("shapes").alias("layer"), F.col("event_id").alias("fid"), kind.alias("geom_type"),
                                 F.array(F.array(ring)).alias("parts"))


@plan("feature_coverage_filter", "J17", f"""
WITH {SHAPES}
SELECT fid, n_nationkey AS coverage FROM shp, boxes WHERE CASE WHEN k = 0 THEN a >= minx AND a < maxx AND c >= miny AND c < maxy AND a+c < maxx+maxy-cut
  ELSE greatest(a,minx) < least(b,maxx) AND greatest(c,miny) < least(d,maxy) AND greatest(a,minx)+greatest(c,miny) < maxx+maxy-cut END""")
def feature_coverage_filter(t: Inputs):
    return vector.features_in_coverages(shapes(t), cut_coverages(t), GEODETIC, depth=5, salts=2).select("fid", "coverage")


@plan("vector_retile", "R5", f"""
WITH {SHAPES},
m AS (SELECT fid, (radians(a)/pi()+1e0)*16e0 AS px0, (radians(b)/pi()+1e0)*16e0 AS px1,
  (1e0-ln(tan(pi()/4e0+radians(least(d, 89.999999e0))/2e0))/pi())*16e0 AS py0, (1e0-ln(tan(pi()/4e0+radians(c)/2e0))/pi())*16e0 AS py1 FROM shp)
SELECT fid, x, y FROM m, range(32) u(x), range(32) v(y) WHERE x BETWEEN floor(px0-0.2e0+1e-9) AND ceil(px1+0.2e0-1e-9)-1 AND y BETWEEN floor(py0-0.2e0+1e-9) AND ceil(py1+0.2e0-1e-9)-1""")
def vector_retile(t: Inputs):
    tiled = vector.retile(shapes(t), WEBMERCATOR, 5, "EPSG:4326")
    return tiled.select("fid", "x", "y")


@plan("vector_tile_merge", "A10", f"""
WITH {FEATURES}, u AS (SELECT * FROM feat UNION ALL SELECT * FROM feat WHERE bal > 0)
SELECT z, x, y, layer, count(*) AS n_features, cast(sum(bal) AS bigint) AS balance FROM u GROUP BY 1,2,3,4""")
def vector_tile_merge(t: Inputs):
    f = features(t)
    again = f.filter(F.col("props")["balance"].cast("long") > 0)
    empty = f.filter(F.col("geom_type") == "LineString").withColumn("parts", F.lit(None).cast(f.schema["parts"].dataType))
    merged = vector.merge_layers([f, again, empty])
    return merged.groupBy("z", "x", "y", "layer").agg(
        F.count(F.lit(1)).alias("n_features"), F.sum(F.col("props")["balance"].cast("long")).alias("balance"))


@plan("tile_statistics", "A3", f"""
WITH {FEATURES},
p AS (SELECT layer, 'balance' AS attribute, cast(bal AS varchar) AS value FROM feat UNION ALL SELECT layer, 'segment', layer FROM feat WHERE geom_type='Point'
  UNION ALL SELECT layer, 'layer', own FROM feat WHERE own IS NOT NULL),
g AS (SELECT layer, count(*) AS features, any_value(geom_type) AS geometry FROM feat GROUP BY 1)
SELECT layer, features, geometry, attribute, CASE WHEN count(try_cast(value AS double)) = count(*) THEN 'Number' ELSE 'String' END AS type, count(*) AS count,
  count(DISTINCT value) AS n_values, min(try_cast(value AS double)) AS min, max(try_cast(value AS double)) AS max FROM p JOIN g USING (layer) GROUP BY 1,2,3,4""")
def tile_statistics(t: Inputs):
    f = features(t)
    layers = vector.layer_stats(f).withColumnRenamed("count", "features")
    return vector.attribute_stats(f).join(layers, "layer")


@plan("vector_layer_catalog", "A4", f"""
WITH {FEATURES},
l AS (SELECT layer, min(z) AS minzoom, max(z) AS maxzoom, bool_or(own IS NOT NULL) AS has_own, any_value(geom_type) AS g FROM feat GROUP BY 1),
j AS (SELECT layer, minzoom, maxzoom, concat('{{"id":"', layer, '","fields":{{"balance":"Number"', CASE WHEN g='Point' THEN ',"segment":"String"' WHEN has_own THEN ',"layer":"String"' ELSE '' END,
  '}},"minzoom":', cast(minzoom AS varchar), ',"maxzoom":', cast(maxzoom AS varchar), '}}') AS entry FROM l)
SELECT 'demo.tiles' AS id, concat('{{"tilejson":"3.0.0","version":"1.0.0","scheme":"xyz","id":"demo.tiles","type":"vector","tiles":["/demo/{{z}}/{{x}}/{{y}}.mvt"],"minzoom":',
  cast(min(minzoom) AS varchar), ',"maxzoom":', cast(max(maxzoom) AS varchar), ',"vector_layers":[', string_agg(entry, ',' ORDER BY entry), ']}}') AS tilejson FROM j""")
def vector_layer_catalog(t: Inputs):
    return vector.tilejson(vector.vector_layers(features(t)), "demo.tiles", "/demo/{z}/{x}/{y}.mvt")


INFO = """i AS (SELECT query_id, minx + (query_id%width)*(maxx-minx)/width AS px, miny + (height-query_id*7%height)*(maxy-miny)/height AS py,
   16e0*least((maxx-minx)/width, (maxy-miny)/height) AS tol, x1, y1, x2, y2 FROM map_queries
   JOIN (SELECT n_nationkey AS n, minx-40e0 AS x1, miny-40e0 AS y1, maxx+40e0 AS x2, maxy+40e0 AS y2 FROM boxes) g ON n = query_id%25),
h AS (SELECT query_id, event_type AS layer, event_id AS fid FROM i JOIN event_points ON abs(lon-px) <= tol AND abs(lat-py) <= tol
   WHERE px >= x1 AND px <= x2 AND py >= y1 AND py <= y2)"""


@plan("feature_info", "J11 L2", f"""
WITH {INFO} SELECT query_id, layer, fid, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY layer, fid) AS rank FROM h) WHERE rank <= 2""")
def feature_info(t: Inputs):
    guards = t.boxes.select("n_nationkey", geo.bbox(F.col("minx") - 40, F.col("miny") - 40, F.col("maxx") + 40, F.col("maxy") + 40).alias("guard"))
    asked = box_of(t.map_queries).withColumn("n_nationkey", (F.col("query_id") % 25).cast("int")).join(guards, "n_nationkey").select(
        "query_id", "box", "width", "height", (F.col("query_id") % F.col("width")).alias("pos_x"),
        (F.col("query_id") * 7 % F.col("height")).alias("pos_y"), "guard")
    points = t.event_points.select(F.col("event_id").alias("fid"), F.col("event_type").alias("layer"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    return vector.feature_info(asked, points, radius_px=16, feature_count=2, cell=0.5, salts=2).select("query_id", "layer", "fid", "rank")


@plan("top_features_per_tile", "L2", f"""
WITH {FEATURES} SELECT z, x, y, layer, fid, rank FROM (SELECT *, row_number() OVER (PARTITION BY z, x, y ORDER BY bal DESC, layer, fid) AS rank FROM feat) WHERE rank <= 3""")
def top_features_per_tile(t: Inputs):
    f = features(t).withColumn("bal", F.col("props")["balance"].cast("long"))
    return vector.top_per_key(f, ["z", "x", "y"], [F.desc("bal"), "layer", "fid"], 3).select("z", "x", "y", "layer", "fid", "rank")


@plan("feature_info_json_merge", "A16", """
WITH f AS (SELECT request, min(ord) FILTER (WHERE l_linestatus='O') AS first_map FROM info_docs GROUP BY 1)
SELECT request, 'id' AS path, cast(arg_max(l_partkey, ord) AS varchar) AS value FROM info_docs GROUP BY 1
UNION ALL SELECT request, 'info.flag', concat('"', arg_max(l_returnflag, ord), '"') FROM info_docs GROUP BY 1
UNION ALL SELECT request, 'info.qty', concat('[', string_agg(cast(qty AS varchar), ',' ORDER BY ord), ']') FROM info_docs GROUP BY 1
UNION ALL SELECT request, 'x.k', cast(arg_max(l_suppkey, ord) AS varchar) FROM info_docs JOIN f USING (request) WHERE l_linestatus='O' GROUP BY 1
UNION ALL SELECT request, 'x', concat('"s', cast(arg_max(l_suppkey, ord) AS varchar), '"') FROM info_docs JOIN f USING (request) WHERE first_map IS NULL GROUP BY 1""")
def feature_info_json_merge(t: Inputs):
    merged = vector.combine_json(t.info_docs, ["request"], "ord", "doc")
    return merged.select("request", F.array_join("path", ".").alias("path"), "value")


@plan("feature_info_text_merge", "A16", """
SELECT request, string_agg(doc, chr(10) ORDER BY ord) AS text FROM info_docs GROUP BY 1""")
def feature_info_text_merge(t: Inputs):
    return vector.combine_text(t.info_docs, ["request"], "ord", "doc")
