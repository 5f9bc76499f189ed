"""Keys, grids and level choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilespark.functions import keys, tilemath
from tilespark.plans.inputs import Inputs, merc_x, merc_y
from tilespark.plans.registry import plan


@plan("grid_level_table", "P1", """
WITH opts AS (
  SELECT *, coalesce(max_res, greatest((maxx-minx)/tile_size, (maxy-miny)/tile_size)) AS first_res FROM grid_options),
lv AS (
  SELECT opts.*, z, first_res / CASE WHEN res_factor='sqrt2'
      THEN pow(2e0, z//2) * CASE WHEN z%2=1 THEN sqrt(2e0) ELSE 1e0 END ELSE pow(2e0, z) END AS res
  FROM opts, range(40) r(z) WHERE z < num_levels)
SELECT grid, cast(z AS int) AS z, round(res, 9) AS res,
  cast(greatest(ceil(floor((maxx-minx)/res)/tile_size), 1) AS bigint) AS grid_w,
  cast(greatest(ceil(floor((maxy-miny)/res)/tile_size), 1) AS bigint) AS grid_h
FROM lv WHERE min_res IS NULL OR res >= min_res""")
def grid_level_table(t: Inputs):
    return tilemath.grid_levels(t.grid_options.withColumn("resolutions", F.lit(None).cast("array<double>"))).select(
        "grid", "z", F.round("res", 9).alias("res"), "grid_w", "grid_h")


@plan("tile_matrix_table", "P30", """
WITH opts AS (
  SELECT *, coalesce(max_res, greatest((maxx-minx)/tile_size, (maxy-miny)/tile_size)) AS first_res FROM grid_options),
lv AS (
  SELECT opts.*, z, first_res / CASE WHEN res_factor='sqrt2'
      THEN pow(2e0, z//2) * CASE WHEN z%2=1 THEN sqrt(2e0) ELSE 1e0 END ELSE pow(2e0, z) END AS res
  FROM opts, range(40) r(z) WHERE z < num_levels)
SELECT grid, cast(z AS varchar) AS identifier,
  round(res / 0.00028e0 * CASE WHEN geographic THEN 111319.4907932736e0 ELSE 1e0 END, 2) AS scale_denominator,
  CASE WHEN geographic THEN maxy ELSE minx END AS top_left_1,
  CASE WHEN geographic THEN minx ELSE maxy END AS top_left_2,
  tile_size AS tile_width, tile_size AS tile_height,
  cast(greatest(ceil(floor((maxx-minx)/res)/tile_size), 1) AS bigint) AS matrix_width,
  cast(greatest(ceil(floor((maxy-miny)/res)/tile_size), 1) AS bigint) AS matrix_height
FROM lv WHERE min_res IS NULL OR res >= min_res""")
def tile_matrix_table(t: Inputs):
    options = t.grid_options.withColumn("resolutions", F.lit(None).cast("array<double>"))
    levels = tilemath.grid_levels(options).join(options.select("grid", "geographic"), "grid")
    geographic = F.col("geographic")
    return tilemath.tile_matrices(levels, geographic, geographic).withColumn(
        "scale_denominator", F.round("scale_denominator", 2))


@plan("lonlat_to_tile_key", "P2", f"""
WITH p AS (SELECT *, cast(event_id%15 AS int) AS z, pow(2e0, event_id%15) AS n FROM event_points)
SELECT event_id, z, {merc_x('lon', 'n')} AS x, {merc_y('lat', 'n')} AS y,
  cast(least(floor((lon+180e0)/360e0*n), n-1) AS bigint) AS geo_x,
  cast(least(greatest(floor((lat+90e0)/360e0*n), 0), greatest(floor(n/2e0), 1e0)-1) AS bigint) AS geo_y
FROM p""")
def lonlat_to_tile_key(t: Inputs):
    z = F.col("z")
    return t.event_points.withColumn("z", (F.col("event_id") % 15).cast("int")).select(
        "event_id", "z",
        tilemath.lonlat_to_tile_x(F.col("lon"), z).alias("x"),
        tilemath.lonlat_to_tile_y(F.col("lat"), z).alias("y"),
        tilemath.lonlat_to_geodetic_x(F.col("lon"), z).alias("geo_x"),
        tilemath.lonlat_to_geodetic_y(F.col("lat"), z).alias("geo_y"))


@plan("tile_bounds", "P3", """
SELECT event_id, round(x/16e0*360e0-180e0, 6) AS minx,
  round(degrees(atan(sinh(pi()*(1e0-(y+1)*2e0/16e0)))), 6) AS miny,
  round((x+1)/16e0*360e0-180e0, 6) AS maxx,
  round(degrees(atan(sinh(pi()*(1e0-y*2e0/16e0)))), 6) AS maxy
FROM tile_requests""")
def tile_bounds(t: Inputs):
    box = tilemath.tile_bounds(F.col("x"), F.col("y"), F.col("z"))
    return t.tile_requests.select("event_id", *[F.round(box[c], 6).alias(c) for c in ("minx", "miny", "maxx", "maxy")])


@plan("quadkeys", "P4", f"""
WITH p AS (SELECT *, cast(event_id%19 AS int) AS z, pow(2e0, event_id%19) AS n FROM event_points),
k AS (SELECT event_id, z, {merc_x('lon', 'n')} AS x, {merc_y('lat', 'n')} AS y FROM p)
SELECT event_id, z, x, y,
  array_to_string([cast(((x >> cast(z-i-1 AS int)) & 1) + 2*((y >> cast(z-i-1 AS int)) & 1) AS varchar)
                   for i in range(z)], '') AS quadkey
FROM k""")
def quadkeys(t: Inputs):
    z = (F.col("event_id") % 19).cast("int")
    keyed = t.event_points.select(
        "event_id", z.alias("z"), tilemath.lonlat_to_tile_x(F.col("lon"), z).alias("x"),
        tilemath.lonlat_to_tile_y(F.col("lat"), z).alias("y"))
    return keyed.withColumn("quadkey", keys.quadkey(F.col("x"), F.col("y"), F.col("z")))


@plan("tile_paths", "P5", """
WITH k AS (SELECT o_orderkey, cast(o_orderkey%22 AS int) AS z, o_orderkey*7919 AS x, o_orderkey*104729 AS y FROM orders)
SELECT o_orderkey,
  printf('%02d/%03d/%03d/%03d/%03d/%03d/%03d.png', z, x//1000000, x//1000%1000, x%1000, y//1000000, y//1000%1000, y%1000) AS tc,
  printf('%02d/%04d/%04d/%04d/%04d.png', z, x//10000, x%10000, y//10000, y%10000) AS mp,
  printf('%d/%d/%d.png', z, x, y) AS tms,
  printf('%d/%d/%d.png', y, x, z) AS reverse_tms,
  printf('L%02d/R%08x/C%08x.png', z, y, x) AS arcgis,
  printf('%02d', z) AS level_dir, printf('L%02d', z) AS arcgis_level_dir
FROM k""")
def tile_paths(t: Inputs):
    k = t.orders.select("o_orderkey", (F.col("o_orderkey") % 22).cast("int").alias("z"),
                        (F.col("o_orderkey") * 7919).alias("x"), (F.col("o_orderkey") * 104729).alias("y"))
    x, y, z, ext = F.col("x"), F.col("y"), F.col("z"), F.lit("png")
    return k.select(
        "o_orderkey", *[keys.tile_path(n, x, y, z, ext).alias(n) for n in ("tc", "mp", "tms", "reverse_tms", "arcgis")],
        keys.level_dir("tc", z).alias("level_dir"), keys.level_dir("arcgis", z).alias("arcgis_level_dir"))


@plan("origin_flip", "P6", """
SELECT event_id, x, z, req_origin, grid_origin,
  CASE WHEN (req_origin='nw' AND grid_origin NOT IN ('ul','nw')) OR (req_origin='sw' AND grid_origin NOT IN ('ll','sw'))
       THEN 15-y ELSE y END AS y
FROM (SELECT *, CASE user_id%3 WHEN 0 THEN 'nw' WHEN 1 THEN 'sw' END AS req_origin,
             CASE user_id%4 WHEN 0 THEN 'ul' WHEN 1 THEN 'nw' WHEN 2 THEN 'll' ELSE 'sw' END AS grid_origin
      FROM tile_requests)""")
def origin_flip(t: Inputs):
    user = F.col("user_id")
    req = F.when(user % 3 == 0, "nw").when(user % 3 == 1, "sw")
    own = F.when(user % 4 == 0, "ul").when(user % 4 == 1, "nw").when(user % 4 == 2, "ll").otherwise("sw")
    df = t.tile_requests.withColumn("req_origin", req).withColumn("grid_origin", own)
    height = tilemath.WEBMERCATOR.grid_h(F.col("z"))
    return df.select("event_id", "x", "z", "req_origin", "grid_origin", keys.to_grid_origin(
        F.col("y"), height, F.col("req_origin"), F.col("grid_origin")).alias("y"))


@plan("level_remap", "P7", """
SELECT event_id, z,
  CASE WHEN z >= 0 THEN (z + CASE WHEN prof AND skip1 THEN 1 ELSE 0 END) * CASE WHEN odd THEN 2 ELSE 1 END END AS internal_z,
  CASE WHEN z >= 0 THEN CASE WHEN odd THEN cast(trunc((z - CASE WHEN prof AND skip1 THEN 1 ELSE 0 END)/2e0) AS int)
       ELSE z - CASE WHEN prof AND skip1 THEN 1 ELSE 0 END END END AS external_z
FROM (SELECT event_id, cast(event_id%21 AS int) - 1 AS z, user_id%2=0 AS skip1, user_id%3=0 AS odd, user_id%5<3 AS prof FROM events)""")
def level_remap(t: Inputs):
    user = F.col("user_id")
    df = t.events.select("event_id", ((F.col("event_id") % 21).cast("int") - 1).alias("z"),
                         (user % 2 == 0).alias("skip1"), (user % 3 == 0).alias("odd"), (user % 5 < 3).alias("prof"))
    args = (F.col("z"), F.col("skip1"), F.col("odd"), F.col("prof"))
    return df.select("event_id", "z", keys.internal_level(*args).alias("internal_z"),
                     keys.external_level(*args).alias("external_z"))


@plan("meta_tile_members", "P8", """
WITH m AS (SELECT DISTINCT layer, x - x%4 AS mx, y - y%4 AS my FROM tile_requests)
SELECT layer, mx, my, mx+dx AS x, my+dy AS y, dx*256 AS off_x, dy*256 AS off_y
FROM m, range(4) a(dx), range(4) b(dy)""")
def meta_tile_members(t: Inputs):
    from tilespark.operators.tiling import meta_members, meta_tiles

    metas = meta_tiles(t.tile_requests, 4).select("layer", "z", "mx", "my").distinct()
    return meta_members(metas, tilemath.WEBMERCATOR, 4).select("layer", "mx", "my", "x", "y", "off_x", "off_y")


@plan("parent_child_chain", "P9", """
WITH d AS (SELECT DISTINCT x, y FROM tile_requests)
SELECT x, y, x>>1 AS parent_x, y>>1 AS parent_y, x*2+dx AS child_x, y*2+dy AS child_y
FROM d, range(2) a(dx), range(2) b(dy)""")
def parent_child_chain(t: Inputs):
    d = t.tile_requests.select("x", "y", "z").distinct()
    x, y = F.col("x"), F.col("y")
    return d.select("x", "y", keys.parent(x).alias("parent_x"), keys.parent(y).alias("parent_y"),
                    F.explode(keys.children(x, y, F.col("z"))).alias("c")).select(
        "x", "y", "parent_x", "parent_y", F.col("c.x").alias("child_x"), F.col("c.y").alias("child_y"))


MERC_RES = "(SELECT z, 2e0*20037508.342789244e0/256e0/pow(2e0,z) AS res FROM range(20) r(z))"


@plan("level_for_bbox", "P10", f"""
WITH q AS (
  SELECT query_id, width,
    (radians(maxx)-radians(minx))*6378137e0/width AS need FROM map_queries),
lv AS {MERC_RES},
a AS (SELECT query_id, coalesce(min(z) FILTER (WHERE res < need), 0) AS zoom,
             coalesce(min(z) FILTER (WHERE res <= need*1.15e0), 19) AS closest
      FROM q, lv GROUP BY query_id)
SELECT query_id, cast(zoom AS int) AS zoom, cast(closest AS int) AS closest FROM a""")
def level_for_bbox(t: Inputs):
    from tilespark.functions.geometry import bbox, reproject_bbox

    box = reproject_bbox(bbox(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")]), "EPSG:4326", "EPSG:3857")
    need = (box.maxx - box.minx) / F.col("width")
    return t.map_queries.withColumn("need", need).select(
        "query_id", tilemath.WEBMERCATOR.first_finer_level(F.col("need")).alias("zoom"),
        tilemath.WEBMERCATOR.closest_level(F.col("need")).alias("closest"))


@plan("level_sets", "P11", f"""
WITH lv AS {MERC_RES},
s AS (SELECT p_partkey, p_size-25 AS a, p_size+5 AS b,
        CASE WHEN p_partkey%4=0 THEN -1 ELSE p_size%20 END AS lo, CASE WHEN p_partkey%3=0 THEN -1 ELSE p_size%20+4 END AS hi,
        cast(1000*p_size as double) AS r1, cast(10*p_size as double) AS r2 FROM part),
c AS (SELECT p_partkey, coalesce(min(z) FILTER (WHERE res <= r1*1.15e0), 19) AS c1,
             coalesce(min(z) FILTER (WHERE res <= r2*1.15e0), 19) AS c2 FROM s, lv GROUP BY 1),
u AS (
  SELECT s.p_partkey, 'list' AS kind, z FROM s, (SELECT z FROM range(20) r(z)) WHERE z = a OR z = b
  UNION ALL
  SELECT p_partkey, 'range', z FROM s, range(20) r(z)
  WHERE z >= CASE WHEN lo=-1 THEN 0 ELSE lo END AND z <= CASE WHEN hi=-1 THEN 19 ELSE least(hi,19) END
  UNION ALL
  SELECT p_partkey, 'resolution_range', z FROM c, range(20) r(z) WHERE z BETWEEN c1 AND c2
  UNION ALL
  SELECT p_partkey, 'resolution_list', c1 FROM c UNION ALL SELECT p_partkey, 'resolution_list', c2 FROM c)
SELECT p_partkey, kind, cast(z AS int) AS z FROM u""")
def level_sets(t: Inputs):
    grid = tilemath.WEBMERCATOR
    n = F.lit(grid.levels)
    size, key = F.col("p_size"), F.col("p_partkey")
    sets = {
        "list": tilemath.levels_from_list(F.array(size - 25, size + 5), n),
        "range": tilemath.levels_from_range(
            F.when(key % 4 == 0, -1).otherwise(size % 20), F.when(key % 3 == 0, -1).otherwise(size % 20 + 4), n),
        "resolution_range": tilemath.levels_from_resolution_range(grid, size * 1000.0, size * 10.0),
        "resolution_list": tilemath.levels_from_resolutions(grid, F.array(size * 1000.0, size * 10.0)),
    }
    table = F.create_map(*[c for name, s in sets.items() for c in (F.lit(name), s)])
    return t.part.select("p_partkey", F.explode(table).alias("kind", "levels")).select(
        "p_partkey", "kind", F.explode("levels").alias("z"))


@plan("tile_validity", "F6", """
SELECT p_partkey, z, x, y,
  CASE WHEN z < 0 OR z > 30 THEN 'zoom' WHEN x < 0 OR y < 0 THEN 'negative'
       WHEN x >= pow(2e0, least(z,19)) OR y >= pow(2e0, least(z,19)) THEN 'outside' ELSE 'ok' END AS verdict
FROM (SELECT p_partkey, p_size-10 AS z, p_partkey*3-500 AS x, p_partkey*5-700 AS y FROM part)""")
def tile_validity(t: Inputs):
    from tilespark.operators.tiling import key_verdict

    df = t.part.select("p_partkey", (F.col("p_size") - 10).alias("z"), (F.col("p_partkey") * 3 - 500).alias("x"),
                       (F.col("p_partkey") * 5 - 700).alias("y"))
    return df.withColumn("verdict", key_verdict(tilemath.WEBMERCATOR))


@plan("coordinate_sort", "L1", """
SELECT event_id, lat, lon, row_number() OVER (PARTITION BY user_id ORDER BY lat, lon, event_id) AS ord
FROM (SELECT event_id, user_id, round(lat,6) AS lat, round(lon,6) AS lon FROM event_points)""")
def coordinate_sort(t: Inputs):
    from tilespark.operators.ordering import ranked_sort

    pts = t.event_points.select("event_id", "user_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))
    return ranked_sort(pts, ["user_id"], F.floor(F.col("lat") * 1024).cast("long"), ["lat", "lon", "event_id"], "ord").select(
        "event_id", "lat", "lon", "ord")
