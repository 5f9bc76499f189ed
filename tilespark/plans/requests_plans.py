"""Request logs, URL admission and fetch scheduling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilespark.functions import requests as req
from tilespark.functions.once import once
from tilespark.operators import fetch
from tilespark.plans.inputs import Inputs
from tilespark.plans.registry import plan
from tilespark.sources import access_log


@plan("tile_url_parse", "P14", """
SELECT event_id, path,
  CASE event_id%8 WHEN 0 THEN 'xyz' WHEN 1 THEN 'xyz' WHEN 2 THEN 'tms' WHEN 3 THEN 'mapbox' WHEN 4 THEN 'cesium' WHEN 5 THEN 'wmts' WHEN 6 THEN 'xyz' END AS family,
  CASE WHEN event_id%8 < 7 THEN concat('layer_', cast(layer AS varchar)) END AS layer,
  CASE event_id%8 WHEN 1 THEN 'hd' WHEN 2 THEN 'EPSG900913' WHEN 5 THEN 'GLOBAL_WEBMERCATOR' END AS layer_spec,
  CASE WHEN event_id%8 = 6 THEN -z WHEN event_id%8 < 7 THEN z END AS z, CASE WHEN event_id%8 < 7 THEN x END AS x, CASE WHEN event_id%8 < 7 THEN y END AS y,
  CASE WHEN event_id%8 = 3 THEN cast(2 AS int) END AS retina,
  CASE event_id%8 WHEN 2 THEN 'jpeg' WHEN 3 THEN 'mvt' WHEN 4 THEN 'terrain' WHEN 7 THEN NULL ELSE 'png' END AS format,
  CASE event_id%8 WHEN 6 THEN 'negative coordinate' WHEN 7 THEN 'no match' END AS reason
FROM service_urls""")
def tile_url_parse(t: Inputs):
    parsed = t.service_urls.select("event_id", "path").withColumn("family", req.url_family(F.col("path")))
    parsed = parsed.withColumn("p", req.parse_tile_url(F.col("path"), F.col("family")))
    return parsed.select("event_id", "path", "family", *[F.col(f"p.{c}").alias(c) for c in (
        "layer", "layer_spec", "z", "x", "y", "retina", "format", "reason")])


@plan("query_string_normalise", "P15", """
WITH n AS (SELECT *, o_custkey%4 AS k, o_orderkey%170 AS ia, o_custkey%80 AS ib FROM service_queries)
SELECT o_orderkey, concat(
    CASE WHEN k = 0 OR k = 1 THEN concat('BBOX=', a, '%2C', b, '%2C', cast(ia+5 AS varchar), '%2C', cast(ib+7 AS varchar), '&')
         WHEN k = 2 THEN concat('BBOX=', a, '%2C', b, '%2Ceast%2C', cast(ib+7 AS varchar), '&') ELSE '' END,
    CASE o_custkey%5 WHEN 0 THEN '' WHEN 1 THEN 'HEIGHT=tall&' ELSE concat('HEIGHT=', cast(128*(1+o_custkey%3) AS varchar), '&') END,
    'LAYERS=roads%2Crivers+x&SERVICE=WMS&TILECOL=', a, '&TILEMATRIX=', cast(ia+5 AS varchar),
    CASE o_custkey%3 WHEN 0 THEN '' WHEN 1 THEN '&TILEROW=north' ELSE concat('&TILEROW=', b) END,
    '&WIDTH=', cast(256*(1+o_custkey%4) AS varchar)) AS canonical,
  CASE WHEN k < 2 THEN cast(ia AS double) ELSE 0e0 END AS minx, CASE WHEN k < 2 THEN cast(ib AS double) ELSE 0e0 END AS miny,
  CASE WHEN k < 2 THEN cast(ia+5 AS double) ELSE 0e0 END AS maxx, CASE WHEN k < 2 THEN cast(ib+7 AS double) ELSE 0e0 END AS maxy,
  CASE WHEN o_custkey%5 < 2 THEN 0 ELSE 256*(1+o_custkey%4) END AS width, CASE WHEN o_custkey%5 < 2 THEN 0 ELSE 128*(1+o_custkey%3) END AS height,
  CASE WHEN o_custkey%3 = 1 THEN -1 ELSE ia END AS x, CASE o_custkey%3 WHEN 2 THEN ib ELSE -1 END AS y,
  CASE WHEN o_custkey%3 = 1 THEN -1 ELSE ia+5 END AS z
FROM n""")
def query_string_normalise(t: Inputs):
    q = once(t.service_queries.select("o_orderkey", "query"), "params", req.query_params(F.col("query")))
    params = F.col("params")
    q = q.select("o_orderkey", req.canonical_query(params).alias("canonical"), req.param_bbox(params).alias("box"),
                 req.param_size(params).alias("image"), req.param_tile(params).alias("tile"))
    return q.select("o_orderkey", "canonical", "box.*", "image.*", "tile.*")


@plan("access_log_rows", "S11 P14 P15", """
SELECT event_id AS id, 'tile' AS kind, CASE event_id%8 WHEN 0 THEN 'xyz' WHEN 1 THEN 'xyz' WHEN 2 THEN 'tms' WHEN 3 THEN 'mapbox' WHEN 4 THEN 'cesium' WHEN 5 THEN 'wmts' WHEN 6 THEN 'xyz' END AS family,
  CASE WHEN event_id%8 < 7 THEN concat('layer_', cast(layer AS varchar)) END AS layer,
  CASE WHEN event_id%8 = 6 THEN -z WHEN event_id%8 < 7 THEN z END AS z, cast(NULL AS double) AS minx, cast(NULL AS bigint) AS width,
  CASE event_id%8 WHEN 6 THEN 'negative coordinate' WHEN 7 THEN 'no match' END AS reason FROM service_urls
UNION ALL
SELECT o_orderkey, 'map', 'wms', 'roads', NULL, CASE WHEN o_custkey%4 < 2 THEN cast(o_orderkey%170 AS double) ELSE 0e0 END,
  CASE WHEN o_custkey%5 < 2 THEN 0 ELSE 256*(1+o_custkey%4) END, NULL FROM service_queries
UNION ALL
SELECT o_orderkey, 'key', 'wmts_kvp', 'roads', cast(CASE WHEN o_custkey%3 = 1 THEN -1 ELSE o_orderkey%170+5 END AS int), NULL, NULL,
  CASE WHEN o_custkey%3 <> 2 THEN 'bad number' END FROM service_queries
UNION ALL
SELECT o_orderkey, 'export', 'arcgis', 'show:1', NULL, CASE WHEN o_custkey%7 > 0 THEN cast(o_orderkey%170 AS double) ELSE 0e0 END, 256*(1+o_custkey%4), NULL FROM service_queries""")
def access_log_rows(t: Inputs):
    # tiles asked by keys and values, some with a row that is no number or without one; exports, some with a side missing
    q = t.service_queries
    row = F.when(F.col("o_custkey") % 3 == 1, "&TileRow=north").when(F.col("o_custkey") % 3 == 2, F.concat(F.lit("&TILEROW="), "b")).otherwise("")
    keyed = q.select(F.col("o_orderkey").alias("id"), F.lit("key").alias("kind"), F.concat(
        F.lit("/wmts?SERVICE=wmts&Layer=roads&TileMatrixSet=g&tilecol="), "a", row, F.lit("&TILEMATRIX="), (F.col("o_orderkey") % 170 + 5).cast("string"), F.lit("&format=image/png")).alias("url"))
    side = F.when(F.col("o_custkey") % 7 > 0, F.concat(F.lit(","), (F.col("o_custkey") % 80 + 7).cast("string"))).otherwise("")
    export = q.select(F.col("o_orderkey").alias("id"), F.lit("export").alias("kind"), F.concat(
        F.lit("/arcgis/rest/services/roads/MapServer/export?bbox="), "a", F.lit(","), "b", F.lit(","), (F.col("o_orderkey") % 170 + 5).cast("string"), side,
        F.lit("&size="), (256 * (F.col("o_custkey") % 4 + 1)).cast("string"), F.lit(",128&layers=show:1")).alias("url"))
    log = t.service_urls.select(F.col("event_id").alias("id"), F.lit("tile").alias("kind"), F.col("path").alias("url")).unionByName(
        t.service_queries.select(F.col("o_orderkey").alias("id"), F.lit("map").alias("kind"), F.concat(F.lit("/service?"), "query").alias("url")))
    return access_log.parse_access_log(log.unionByName(keyed).unionByName(export)).select(
        "id", "kind", "family", "layer", "z", F.col("box.minx").alias("minx"), F.col("image.width").alias("width"), "reason")


@plan("layer_name_validity", "F10", """
SELECT p_partkey, regexp_full_match(p_name, '[a-zA-Z0-9_-]{1,256}') AS name_ok, regexp_full_match(p_brand, '[a-zA-Z0-9_-]{1,256}') AS brand_ok,
  regexp_full_match(replace(p_name, ' ', '_'), '[a-zA-Z0-9_-]{1,256}') AS fixed_ok FROM part""")
def layer_name_validity(t: Inputs):
    return t.part.select("p_partkey", req.valid_layer_name(F.col("p_name")).alias("name_ok"),
                         req.valid_layer_name(F.col("p_brand")).alias("brand_ok"),
                         req.valid_layer_name(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("fixed_ok"))


HOST = "regexp_extract(url, '://([^/:?#]+)', 1)"


@plan("url_admission", "F9", f"""
WITH u AS (SELECT page_id, url, {HOST} AS host FROM log_urls)
SELECT page_id, host, CASE WHEN regexp_matches(url, '\\.html(\\?|#|$)') THEN 'forbidden url'
  WHEN NOT regexp_matches(url, '/(en|fr|de)/') THEN 'no filter matches'
  WHEN length(host)%5 = 0 OR host LIKE '%.org' THEN 'forbidden domain' END AS reason FROM u""")
def url_admission(t: Inputs):
    hosts = t.log_urls.select(req.url_host(F.col("url")).alias("host")).distinct()
    return fetch.admit(
        t.log_urls.select("page_id", "url"), deny=[r"\.html(\?|#|$)"], allow=["/(en|fr|de)/"],
        denied_hosts=hosts.filter("length(host) % 5 = 0"), allowed_hosts=hosts.filter("host NOT LIKE '%.org'"),
    ).select("page_id", "host", "reason")


@plan("content_path", "P27", """
SELECT page_id, concat(substr(sha1(url), 1, 2), '/', sha1(url)) AS path FROM log_urls""")
def content_path(t: Inputs):
    return t.log_urls.select("page_id", req.content_path(F.col("url")).alias("path"))


RULES = (fetch.FetchRule(r"^blog\.", 500, 2), fetch.FetchRule(r"\.net$", 250, 3), fetch.FetchRule(r"\.com$", 100, 1))


@plan("fetch_schedule", "W7", f"""
WITH u AS (SELECT page_id, {HOST} AS host FROM log_urls),
r AS (SELECT *, CASE WHEN host LIKE 'blog.%' THEN 0 WHEN host LIKE '%.net' THEN 1 WHEN host LIKE '%.com' THEN 2 END AS rule,
      row_number() OVER (PARTITION BY host ORDER BY page_id) AS position FROM u)
SELECT page_id, host, cast(rule AS int) AS rule, position,
  cast(CASE rule WHEN 0 THEN (position-1)//2*500 WHEN 1 THEN (position-1)//3*250 WHEN 2 THEN (position-1)*100 ELSE 0 END AS bigint) AS start_ms FROM r""")
def fetch_schedule(t: Inputs):
    urls = t.log_urls.select("page_id", req.url_host(F.col("url")).alias("host"))
    return fetch.schedule(urls, RULES, F.floor(F.col("page_id") / 4096), ["page_id"])


FETCHES = f"""f AS (SELECT url, {HOST} AS host, event_id AS seq, event_type <> 'error' AS ok, event_type <> 'signup' AS cacheable
  FROM events JOIN log_urls ON page_id = event_id%(SELECT count(*) FROM pages))"""


@plan("repeat_fetch_share", "A18", f"""
WITH {FETCHES},
c AS (SELECT * FROM f WHERE cacheable),
l AS (SELECT url, min(seq) AS filled_at FROM c WHERE ok GROUP BY 1),
a AS (SELECT host, count(*) FILTER (WHERE seq > filled_at) AS hits, count(*) FILTER (WHERE seq = filled_at) AS misses FROM c JOIN l USING (url) GROUP BY 1)
SELECT host, hits, misses, round(hits/(hits+misses), 6) AS hit_ratio FROM a""")
def repeat_fetch_share(t: Inputs):
    n = t.pages.agg(F.count(F.lit(1)).alias("n"))
    asked = t.events.join(F.broadcast(n)).withColumn("page_id", F.col("event_id") % F.col("n"))  # one-row side
    fetches = asked.join(t.log_urls, "page_id").select(
        "url", req.url_host(F.col("url")).alias("host"), F.col("event_id").alias("seq"),
        (F.col("event_type") != "error").alias("ok"), (F.col("event_type") != "signup").alias("cacheable"))
    return fetch.repeat_share(fetches).withColumn("hit_ratio", F.round("hit_ratio", 6))
