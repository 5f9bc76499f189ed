"""Descriptions of tilesets, and grids that follow other grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilespark.functions.tilemath import WEBMERCATOR, lonlat_to_tile_x, lonlat_to_tile_y
from tilespark.operators import describe, grids
from tilespark.plans.inputs import Inputs
from tilespark.plans.registry import plan
from tilespark.plans.vector_plans import FEATURES, features

# ---- statistics documents ----------------------------------------------------------------------

MOST, SHARE = 10, 20
CODE = "CASE WHEN fid%3=0 THEN 'c\"0' WHEN fid%5=0 THEN 'c1' ELSE concat('u', cast(fid AS varchar)) END"


@plan("tile_statistics_documents", "A3", f"""
WITH {FEATURES},
p AS (SELECT geom_type AS tileset, layer, 'balance' AS attribute, cast(bal AS varchar) AS value FROM feat UNION ALL SELECT geom_type, layer, 'segment', layer FROM feat WHERE geom_type='Point'
  UNION ALL SELECT geom_type, layer, 'layer', own FROM feat WHERE own IS NOT NULL UNION ALL SELECT geom_type, layer, 'code', {CODE} FROM feat),
n AS (SELECT tileset, layer, attribute, count(*) AS n, count(try_cast(value AS double)) = count(*) AS numeric, min(try_cast(value AS double)) AS mn,
  max(try_cast(value AS double)) AS mx, count(DISTINCT value) AS kinds FROM p GROUP BY 1, 2, 3),
v AS (SELECT tileset, layer, attribute, value, count(*) AS c FROM p GROUP BY 1, 2, 3, 4),
w AS (SELECT v.*, numeric, row_number() OVER (PARTITION BY tileset, layer, attribute ORDER BY c DESC, value) AS r FROM v JOIN n USING (tileset, layer, attribute)
  WHERE kinds <= {MOST} OR c*{SHARE} >= n),
l AS (SELECT tileset, layer, attribute, string_agg(CASE WHEN numeric THEN value ELSE cast(to_json(value) AS varchar) END, ',' ORDER BY r) AS items FROM w WHERE r <= {MOST} GROUP BY 1, 2, 3),
e AS (SELECT tileset, layer, attribute, concat('{{"attribute":"', attribute, '","type":"', CASE WHEN numeric THEN 'Number' ELSE 'String' END, '"',
  CASE WHEN items IS NOT NULL THEN concat(',"values":[', items, ']') ELSE '' END, CASE WHEN numeric AND mn <> 0 THEN concat(',"min":', cast(mn AS varchar)) ELSE '' END,
  CASE WHEN numeric AND mx <> 0 THEN concat(',"max":', cast(mx AS varchar)) ELSE '' END, '}}') AS e FROM n LEFT JOIN l USING (tileset, layer, attribute)),
a AS (SELECT tileset, layer, string_agg(e, ',' ORDER BY attribute) AS a FROM e GROUP BY 1, 2),
g AS (SELECT geom_type AS tileset, layer, count(*) AS n FROM feat GROUP BY 1, 2),
t AS (SELECT tileset, layer, concat('{{"account":"demo","tilesetid":"', tileset, '","layer":"', layer, '","geometry":"', tileset, '","count":', cast(n AS varchar),
  ',"attributes":[', a, ']}}') AS t FROM g JOIN a USING (tileset, layer))
SELECT tileset AS tilesetid, concat('{{"account":"demo","tilesetid":"', tileset, '","layerCount":', cast(count(*) AS varchar), ',"layers":[', string_agg(t, ',' ORDER BY layer), ']}}') AS tilestats
FROM t GROUP BY 1""")
def tile_statistics_documents(t: Inputs):
    fid = F.col("fid")
    code = F.when(fid % 3 == 0, 'c"0').when(fid % 5 == 0, "c1").otherwise(F.concat(F.lit("u"), fid.cast("string")))
    f = features(t).withColumn("props", F.map_concat("props", F.create_map(F.lit("code"), code))).withColumn("tileset", F.col("geom_type"))
    return describe.statistics_documents(f, "tileset", "demo", MOST, SHARE)


# ---- layer descriptions ------------------------------------------------------------------------

RECTS = 40


@plan("layer_description_pieces", "A5", f"""
WITH p AS (SELECT event_type AS tileset, cast(2+event_id%5 AS int) AS z, lon, lat FROM event_points WHERE event_id%5 <> 1),
m AS (SELECT tileset, z, cast(least(greatest(floor((lon+180e0)/360e0*pow(2e0,z)), 0e0), pow(2e0,z)-1e0) AS bigint) AS x,
  cast(least(greatest(floor((1e0-ln(tan(radians(lat))+1e0/cos(radians(lat)))/pi())/2e0*pow(2e0,z)), 0e0), pow(2e0,z)-1e0) AS bigint) AS y FROM p),
d AS (SELECT DISTINCT * FROM m),
a AS (SELECT tileset, z, y, min(x) AS sx, max(x) AS ex FROM (SELECT *, x - row_number() OVER (PARTITION BY tileset, z, y ORDER BY x) AS g FROM d) GROUP BY tileset, z, y, g),
r AS (SELECT tileset, z, sx, ex, min(y) AS sy, max(y) AS ey FROM (SELECT *, y - row_number() OVER (PARTITION BY tileset, z, sx, ex ORDER BY y) AS g FROM a) GROUP BY tileset, z, sx, ex, g),
k AS (SELECT *, row_number() OVER (PARTITION BY tileset, z ORDER BY sx//64, sy//64, sx, sy, ex, ey) - 1 AS k, count(*) OVER (PARTITION BY tileset, z) AS n FROM r),
c AS (SELECT tileset, z, k//{RECTS} AS piece, max((n-1)//{RECTS}) AS last,
  string_agg(concat('{{"startX":', cast(sx AS varchar), ',"startY":', cast(sy AS varchar), ',"endX":', cast(ex AS varchar), ',"endY":', cast(ey AS varchar), '}}'), ',' ORDER BY k) AS list FROM k GROUP BY 1, 2, 3),
b AS (SELECT tileset, min(z) AS lo, max(z) AS hi, min(x/pow(2e0,z)*360e0-180e0) AS minx, max((x+1)/pow(2e0,z)*360e0-180e0) AS maxx,
  min(degrees(atan(sinh(pi()*(1e0-(y+1)*2e0/pow(2e0,z)))))) AS miny, max(degrees(atan(sinh(pi()*(1e0-y*2e0/pow(2e0,z)))))) AS maxy FROM d GROUP BY 1),
l AS (SELECT tileset, z, coalesce(piece, 0) AS piece, coalesce(last, 0) AS last, coalesce(list, '') AS list
  FROM (SELECT tileset, unnest(range(hi+1)) AS z FROM b) q LEFT JOIN c USING (tileset, z))
SELECT tileset, cast(z AS int) AS z, cast(piece AS bigint) AS piece, concat(CASE WHEN z > 0 OR piece > 0 THEN ',' ELSE '' END, CASE WHEN piece = 0 THEN '[' ELSE '' END, list,
  CASE WHEN piece = last THEN ']' ELSE '' END) AS text FROM l
UNION ALL SELECT tileset, -1, 0, concat('{{"name":"', tileset, '","tilejson":"2.1.0","version":"1.0.0","format":"quantized-mesh-1.0","available":[') FROM b
UNION ALL SELECT tileset, hi+1, 0, concat('],"bounds":[', cast(round(minx,6) AS varchar), ',', cast(round(miny,6) AS varchar), ',', cast(round(maxx,6) AS varchar), ',', cast(round(maxy,6) AS varchar),
  '],"minzoom":', cast(lo AS varchar), ',"maxzoom":', cast(hi AS varchar), ',"bvhlevels":0,"projection":"EPSG:4326","scheme":"tms","tiles":["/t/{{z}}/{{x}}/{{y}}"]}}') FROM b""")
def layer_description_pieces(t: Inputs):
    z, lon, lat = (F.col("event_id") % 5 + 2).cast("int"), F.col("lon"), F.col("lat")
    tiles = t.event_points.filter("event_id % 5 <> 1").select(F.col("event_type").alias("tileset"), z.alias("z"), lonlat_to_tile_x(lon, z).alias("x"), lonlat_to_tile_y(lat, z).alias("y"))
    return describe.layer_pieces(tiles, "/t/{z}/{x}/{y}", grid=WEBMERCATOR, piece=RECTS)


# ---- tile descriptions -------------------------------------------------------------------------

SETS = """sets AS (SELECT concat('nation_', cast(n_nationkey AS varchar)) AS id, n_nationkey, 'mvt' AS format, minx, miny, maxx, maxy, 9 AS lo, 3 AS hi, NULL AS kind FROM boxes
  UNION ALL SELECT concat('region_', cast(r_regionkey AS varchar)), NULL, 'webp', -180e0, -85e0, 180e0, 85e0, 0, 12, CASE WHEN r_regionkey=1 THEN 'raster' END FROM region)"""


@plan("tilejson_documents", "A4", f"""
WITH {SETS},
f AS (SELECT concat('nation_', cast(c_nationkey AS varchar)) AS id, c_mktsegment AS layer, 3+c_custkey%5 AS z, c_custkey AS k FROM customer),
l AS (SELECT id, layer, min(z) AS lo, max(z) AS hi, bool_or(k%50 = 0) AS text, bool_or(k%2 = 1) AS odd FROM f GROUP BY 1, 2),
e AS (SELECT id, string_agg(concat('{{"id":"', layer, '","fields":{{"flag":"Boolean","mixed":"', CASE WHEN text THEN 'String' ELSE 'Number' END, '","number":"Number","open":"', CASE WHEN odd THEN 'String' ELSE 'Boolean' END, '"}},"minzoom":',
  cast(lo AS varchar), ',"maxzoom":', cast(hi AS varchar), '}}'), ',' ORDER BY layer) AS layers FROM l GROUP BY 1)
SELECT id, concat('{{"tilejson":"3.0.0","version":"1.0.0","scheme":"xyz","id":"', id, '","type":"', CASE WHEN layers IS NOT NULL THEN 'vector' WHEN kind IS NOT NULL THEN kind WHEN id='region_2' THEN 'raster'
  ELSE 'raster-dem' END, '","format":"', format, '","tiles":["http://tiles/', id, '/{{z}}/{{x}}/{{y}}.', format, '"],"bounds":[', cast(round(minx,6) AS varchar), ',', cast(round(miny,6) AS varchar), ',',
  cast(round(maxx,6) AS varchar), ',', cast(round(maxy,6) AS varchar), '],"center":[', cast(round((minx+maxx)/2e0,6) AS varchar), ',', cast(round((miny+maxy)/2e0,6) AS varchar), ',0.0],"minzoom":',
  cast(least(sets.lo, sets.hi) AS varchar), ',"maxzoom":', cast(greatest(sets.lo, sets.hi) AS varchar), ',"vector_layers":[', coalesce(layers, ''), ']}}') AS tilejson FROM sets LEFT JOIN e USING (id)""")
def tilejson_documents(t: Inputs):
    k = F.col("c_custkey")
    text = k.cast("string")
    # text in one of fifty values; a field that is a flag here and a number there
    props = F.create_map(F.lit("number"), text, F.lit("flag"), F.when(k % 2 == 0, "true").otherwise("false"), F.lit("mixed"), F.when(k % 50 == 0, "x").otherwise(text),
                         F.lit("open"), F.when(k % 2 == 0, "true").otherwise(F.concat(F.lit("v"), text)))
    rows = t.customer.select(F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("tileset"), F.col("c_mktsegment").alias("layer"), (k % 5 + 3).cast("int").alias("z"), props.alias("props"))
    nations = t.boxes.select(F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")).alias("id"), F.lit("mvt").alias("format"), "minx", "miny", "maxx", "maxy",
                             F.lit(9).alias("minzoom"), F.lit(3).alias("maxzoom"), F.lit(None).cast("string").alias("type"))
    side = [F.lit(v).alias(n) for v, n in ((-180.0, "minx"), (-85.0, "miny"), (180.0, "maxx"), (85.0, "maxy"))]
    regions = t.region.select(F.concat(F.lit("region_"), F.col("r_regionkey").cast("string")).alias("id"), F.lit("webp").alias("format"), *side,
                              F.lit(0).alias("minzoom"), F.lit(12).alias("maxzoom"), F.when(F.col("r_regionkey") == 1, "raster").alias("type"))
    sets = nations.unionByName(regions).withColumn("url", F.lit("http://tiles/"))
    return describe.tilejson_documents(sets, describe.layer_catalogue(rows), satellite="region_2")


# ---- aligned grids -----------------------------------------------------------------------------

# two of three grids follow the one with half their number; some follow each other, some nothing that is there
ALIGN = "CASE WHEN grid%97=5 THEN grid+1 WHEN grid%97=6 THEN grid-1 WHEN grid%89=7 THEN -grid WHEN grid%3=0 OR grid < 4 THEN NULL ELSE grid//2 END"


@plan("aligned_grid_levels", "P1", f"""
WITH RECURSIVE o AS (SELECT *, {ALIGN} AS w, coalesce(max_res, greatest((maxx-minx)/tile_size, (maxy-miny)/tile_size)) AS first_res FROM grid_options),
b AS (SELECT grid, list_transform(range(num_levels), lambda z: first_res / CASE WHEN res_factor='sqrt2' THEN pow(2e0, z//2) * CASE WHEN z%2=1 THEN sqrt(2e0) ELSE 1e0 END ELSE pow(2e0, z) END) AS r, min_res
  FROM o WHERE w IS NULL),
rec AS (SELECT grid, list_filter(r, lambda v: min_res IS NULL OR v >= min_res) AS r FROM b
  UNION ALL SELECT grid, CASE WHEN res_factor='sqrt2' AND round(c[1]/c[2], 8) = 2e0 THEN flatten(list_transform(c, lambda v: [v, v/sqrt(2e0)]))
    WHEN res_factor='2' AND round(c[1]/c[2], 8) = round(sqrt(2e0), 8) THEN list_filter(c, lambda v, i: i%2=1) ELSE c END
  FROM (SELECT o.grid, res_factor, list_filter(rec.r, lambda v: v <= first_res AND (min_res IS NULL OR v >= min_res))[1:num_levels] AS c FROM rec JOIN o ON o.w = rec.grid) q),
lost AS (SELECT grid FROM o WHERE w IS NOT NULL AND w NOT IN (SELECT grid FROM o)
  UNION ALL SELECT o.grid FROM lost JOIN o ON o.w = lost.grid)
SELECT grid, cast(len(r) AS int) AS n_levels, round(r[1], 6) AS coarsest, round(r[-1], 6) AS finest, 'levels' AS state FROM rec
UNION ALL SELECT grid, NULL, NULL, NULL, CASE WHEN grid IN (SELECT grid FROM lost) THEN 'unknown' ELSE 'circular' END FROM o WHERE grid NOT IN (SELECT grid FROM rec)""")
def aligned_grid_levels(t: Inputs):
    g = F.col("grid")
    along = F.when(g % 97 == 5, g + 1).when(g % 97 == 6, g - 1).when(g % 89 == 7, -g).when((g % 3 == 0) | (g < 4), None).otherwise(F.floor(g / 2))
    options = t.grid_options.withColumn("resolutions", F.lit(None).cast("array<double>")).withColumn("align_with", along)
    levels, lost = grids.aligned_grid_levels(options)
    ends = [F.round(F.when(F.size("resolutions") > 0, F.element_at("resolutions", i)), 6).alias(n) for i, n in ((1, "coarsest"), (-1, "finest"))]
    known = levels.select("grid", F.size("resolutions").alias("n_levels"), *ends, F.lit("levels").alias("state"))
    none = F.lit(None).cast("double")
    return known.unionByName(lost.select("grid", F.lit(None).cast("int").alias("n_levels"), none.alias("coarsest"), none.alias("finest"), F.col("reason").alias("state")))
