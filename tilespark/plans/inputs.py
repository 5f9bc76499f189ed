"""Input tables of the registered queries.

The given tables hold no tiles, so tile stores, requests, coverages and rasters are derived from
them. A derivation is one SQL text that means the same to Spark and to the checking engine, or a
pair of texts where array syntax differs. Every derivation reads its whole source tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
        "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

MERC = "20037508.342789244e0"


def merc_x(lon: str, n: str) -> str:
    return f"cast(greatest(least(floor(({lon}+180e0)/360e0*{n}),{n}-1e0),0e0) as bigint)"


def merc_y(lat: str, n: str) -> str:
    return (f"cast(greatest(least(floor((1e0-ln(tan(radians({lat}))+1e0/cos(radians({lat})))/pi())"
            f"/2e0*{n}),{n}-1e0),0e0) as bigint)")


# One text for both engines.
SHARED = {
    "event_points": """
        SELECT event_id, ts, user_id, event_type, value,
               (event_id*137.508e0)%360e0-180e0 AS lon, (event_id*61.8034e0)%170e0-85e0 AS lat
        FROM events""",
    "customer_points": """
        SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal AS acctbal,
               (c_custkey*137.508e0)%360e0-180e0 AS lon, (c_custkey*61.8034e0)%170e0-85e0 AS lat
        FROM customer""",
    "supplier_points": """
        SELECT s_suppkey AS id, s_nationkey AS nation, s_acctbal AS acctbal,
               (s_suppkey*137.508e0)%360e0-180e0 AS lon, (s_suppkey*61.8034e0)%170e0-85e0 AS lat
        FROM supplier""",
    "tile_requests": f"""
        SELECT event_id, ts, user_id, event_type, user_id%3 AS service, user_id%4 AS layer,
               cast(4 as int) AS z, {merc_x('lon', '16e0')} AS x, {merc_y('lat', '16e0')} AS y
        FROM event_points""",
    "request_urls": """
        SELECT event_id, concat('/tiles/layer_', cast(layer as varchar(20)), '/', cast(z as varchar(20)), '/',
               cast(x as varchar(20)), '/', cast(y as varchar(20)), '.png') AS path, layer, z, x, y
        FROM tile_requests""",
    "tile_store": """
        SELECT o_orderstatus AS tileset, cast(4 as int) AS z, o_orderkey%16 AS x,
               cast(floor(o_orderkey/16) as bigint)%16 AS y, o_orderdate AS mtime,
               cast(floor(o_totalprice) as bigint) AS size, o_orderkey, o_orderpriority
        FROM orders""",
    "boxes": """
        SELECT n_nationkey, n_name, n_regionkey, r_name,
               n_nationkey*14e0-178e0 AS minx, (n_nationkey%9)*16e0-74e0 AS miny,
               n_nationkey*14e0-158e0 AS maxx, (n_nationkey%9)*16e0-54e0 AS maxy,
               4e0 AS cut
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "map_queries": """
        SELECT o_orderkey AS query_id, o_orderstatus, o_orderpriority,
               (o_orderkey*137.508e0)%320e0-170e0 AS minx, (o_orderkey*61.8034e0)%140e0-80e0 AS miny,
               (o_orderkey*137.508e0)%320e0-170e0 + 1e0 + o_custkey%17 AS maxx,
               (o_orderkey*61.8034e0)%140e0-80e0 + 1e0 + o_custkey%13 AS maxy,
               cast(256*(1+o_custkey%4) as bigint) AS width, cast(256*(1+o_custkey%3) as bigint) AS height,
               CASE WHEN o_custkey%3=0 THEN 'EPSG:4326' WHEN o_custkey%3=1 THEN 'EPSG:3857'
                    ELSE 'EPSG:25832' END AS srs,
               o_orderkey%(SELECT count(*) FROM part) AS layer_key
        FROM orders""",
    "layer_requests": """
        SELECT event_id, ts, user_id, event_type, event_id%(SELECT count(*) FROM part) AS layer_key FROM events""",
    "service_urls": """
        SELECT event_id, ts, user_id, layer, z, x, y, CASE event_id%8
            WHEN 0 THEN concat('/tiles/layer_', l, '/', zxy, '.png')
            WHEN 1 THEN concat('/tiles/1.0.0/layer_', l, '/hd/', zxy, '.png')
            WHEN 2 THEN concat('/tms/1.0.0/layer_', l, '/EPSG900913/', zxy, '.jpeg')
            WHEN 3 THEN concat('/mapbox/layer_', l, '/', zxy, '@2x.mvt')
            WHEN 4 THEN concat('/cesium/layer_', l, '/', zxy, '.terrain')
            WHEN 5 THEN concat('/wmts/layer_', l, '/GLOBAL_WEBMERCATOR/', zxy, '.png')
            WHEN 6 THEN concat('/tiles/layer_', l, '/-', zxy, '.png')
            ELSE concat('/about/layer_', l) END AS path
        FROM (SELECT *, cast(layer AS varchar(20)) AS l,
                concat(cast(z AS varchar(20)), '/', cast(x AS varchar(20)), '/', cast(y AS varchar(20))) AS zxy
              FROM tile_requests) q""",
    "service_queries": """
        SELECT o_orderkey, o_custkey, a, b, concat('service=WMS&Layers=roads&layers=rivers%20x&bad%21key=1&WIDTH=', w,
            CASE o_custkey%5 WHEN 0 THEN '' WHEN 1 THEN '&height=tall' ELSE concat('&height=', h) END,
            CASE o_custkey%4 WHEN 0 THEN concat('&bbox=', a, ',', b, ',', c, ',', d)
              WHEN 1 THEN concat('&bbox=', a, '&BBOX=', b, '&bbox=', c, '&bbox=', d)
              WHEN 2 THEN concat('&bbox=', a, ',', b, ',east,', d) ELSE '' END,
            '&tilecol=', a, CASE o_custkey%3 WHEN 0 THEN '' WHEN 1 THEN '&tilerow=north' ELSE concat('&TileRow=', b) END,
            '&tilematrix=', c) AS query
        FROM (SELECT o_orderkey, o_custkey, cast(o_orderkey%170 AS varchar(20)) AS a, cast(o_custkey%80 AS varchar(20)) AS b,
                cast(o_orderkey%170+5 AS varchar(20)) AS c, cast(o_custkey%80+7 AS varchar(20)) AS d,
                cast(256*(1+o_custkey%4) AS varchar(20)) AS w, cast(128*(1+o_custkey%3) AS varchar(20)) AS h FROM orders) q""",
    "upstream_layers": """
        SELECT p_partkey AS layer_id, p_brand AS name, p_type AS url, p_size,
               CASE WHEN p_size%2=0 THEN 'EPSG:4326' ELSE 'EPSG:3857' END AS srs,
               cast(p_size*4 as double) AS min_res, cast(p_size as double)/50e0 AS max_res,
               (p_partkey%11)/10e0 AS opacity, p_size%3=0 AS transparent,
               p_retailprice, p_partkey%7 AS priority
        FROM part""",
    "grid_options": """
        SELECT p_partkey AS grid, -1000e0*(1+p_size) AS minx, -500e0*(1+p_size) AS miny,
               1000e0*(1+p_size) AS maxx, 800e0*(1+p_size) AS maxy, cast(256 as int) AS tile_size,
               cast(5+p_size%16 as int) AS num_levels,
               CASE WHEN p_partkey%2=0 THEN '2' ELSE 'sqrt2' END AS res_factor,
               CASE WHEN p_partkey%5=0 THEN 0.25e0 END AS min_res,
               CASE WHEN p_partkey%3=0 THEN 16e0 END AS max_res, p_partkey%4=0 AS geographic
        FROM part""",
    "layer_stack": """
        SELECT l_orderkey AS tile_id, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
               cast(floor(l_quantity*5) as bigint) AS value, l_discount*12e0-0.05e0 AS opacity,
               l_discount, l_returnflag
        FROM lineitem""",
    # one JSON document per listed layer of a request
    "info_docs": """
        SELECT *, concat('{"id":', cast(l_partkey AS varchar(20)), ',"info":{"flag":"', l_returnflag, '","qty":[',
            cast(qty AS varchar(20)), ']},"x":', CASE WHEN l_linestatus='O'
              THEN concat('{"k":', cast(l_suppkey AS varchar(20)), '}') ELSE concat('"s', cast(l_suppkey AS varchar(20)), '"') END, '}') AS doc
        FROM (SELECT l_orderkey AS request, row_number() OVER (PARTITION BY l_orderkey
                ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS ord,
                l_partkey, l_suppkey, l_returnflag, cast(floor(l_quantity) AS bigint) AS qty, l_linestatus FROM lineitem) q""",
    "log_urls": """
        SELECT page_id, url, html FROM pages""",
}

# Array syntax differs: (Spark text, checking text).
PAIRED = {
    "raster_tiles": (
        """
        SELECT vec_id%20 AS x, cast(floor(vec_id/20) as bigint) AS y, vec_id, label,
               transform(embedding, v -> cast(floor((cast(v as double)+1e0)*1000e0) as double)) AS vals
        FROM embeddings""",
        """
        SELECT vec_id%20 AS x, cast(floor(vec_id/20) as bigint) AS y, vec_id, label,
               [cast(floor((cast(v as double)+1e0)*1000e0) as double) for v in embedding] AS vals
        FROM embeddings"""),
    "cells": (
        """
        SELECT x, y, vec_id, label, cast(i%8 as bigint) AS col, cast(floor(i/8) as bigint) AS row_no, v
        FROM raster_tiles LATERAL VIEW posexplode(vals) t AS i, v""",
        """
        SELECT x, y, vec_id, label, cast(i%8 as bigint) AS col, cast(i//8 as bigint) AS row_no, vals[i+1] AS v
        FROM raster_tiles, range(64) r(i)"""),
}


def _mentions(text: str, name: str) -> bool:
    return re.search(rf"\b{name}\b", text) is not None


def _needed(sql: str) -> list[str]:
    """Derived tables a text reads, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in (*SHARED, *PAIRED):
            if _mentions(text, name) and name not in order:
                visit(SHARED.get(name) or PAIRED[name][1])
                order.append(name)

    visit(sql)
    return order


def with_clause(sql: str) -> str:
    """Prefix a checking query with the derived tables it reads."""
    body = sql.strip()
    parts = [f"{n} AS ({SHARED.get(n) or PAIRED[n][1]})" for n in _needed(body)]
    if not parts:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


class Inputs:
    """Given and derived tables of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = str(sf_dir).rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        text = SHARED.get(name) or (PAIRED[name][0] if name in PAIRED else None)
        if text is None:
            raise AttributeError(name)
        sources = {n: getattr(self, n) for n in (*BASE, *SHARED, *PAIRED)
                   if n != name and _mentions(text, n)}
        literal = text.replace("{", "{{").replace("}", "}}")
        bound = re.sub(r"\b(FROM|JOIN)\s+(" + "|".join(sources) + r")\b", r"\1 {\2}", literal)
        return self.spark.sql(bound, **sources)
