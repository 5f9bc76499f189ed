"""Coverages, boxes and reprojection."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilespark.functions import coverages as texts
from tilespark.functions import geometry as geo
from tilespark.functions.tilemath import GEODETIC, buffered_bbox
from tilespark.operators import coverage as cov
from tilespark.plans.inputs import Inputs
from tilespark.plans.registry import plan

SIDES = ("minx", "miny", "maxx", "maxy")


def box_of(df, name="box"):
    return df.withColumn(name, geo.bbox(*[F.col(c) for c in SIDES])).drop(*SIDES)


def cut_coverages(t: Inputs):
    """Nation boxes with their upper-right corner cut off, as polygons."""
    c = F.col
    ring = F.array(
        geo.vertex(c("minx"), c("miny")), geo.vertex(c("maxx"), c("miny")),
        geo.vertex(c("maxx"), c("maxy") - c("cut")), geo.vertex(c("maxx") - c("cut"), c("maxy")),
        geo.vertex(c("minx"), c("maxy")))
    return box_of(t.boxes.withColumn("polygon", F.array(ring))).select(
        F.col("n_nationkey").alias("coverage"), "n_regionkey", "box", "polygon")


def box_coverages(t: Inputs):
    return box_of(t.boxes).select(
        F.col("n_nationkey").alias("coverage"), "n_regionkey", "box",
        F.lit(None).cast("array<array<struct<x:double,y:double>>>").alias("polygon"))


def queries_with_extent(t: Inputs):
    """Map queries, each with the box of one nation as its extent."""
    extents = box_of(t.boxes, "extent").select("n_nationkey", "extent")
    q = box_of(t.map_queries).withColumn("n_nationkey", (F.col("query_id") % 25).cast("int"))
    return q.join(extents, "n_nationkey")


# geodetic tiles of a level: (x, y) with their box
GEO_TILES = """
  SELECT z, x, y, x*360e0/pow(2e0,z)-180e0 AS a, y*360e0/pow(2e0,z)-90e0 AS c,
         (x+1)*360e0/pow(2e0,z)-180e0 AS b, (y+1)*360e0/pow(2e0,z)-90e0 AS d
  FROM range(7) r(z), range(64) rx(x), range(32) ry(y)
  WHERE x < pow(2e0,z) AND y < greatest(pow(2e0,z)/2e0, 1e0)"""
CUT_TOUCH = """greatest(a,minx) < least(b,maxx) AND greatest(c,miny) < least(d,maxy)
   AND greatest(a,minx)+greatest(c,miny) < maxx+maxy-cut"""
CUT_INSIDE = "a >= minx AND b <= maxx AND c >= miny AND d <= maxy AND b+d <= maxx+maxy-cut"


@plan("coverage_classify", "F1", """
SELECT query_id, CASE WHEN a >= minx AND b <= maxx AND c >= miny AND d <= maxy AND b+d <= maxx+maxy-cut THEN 'CONTAINS'
  WHEN greatest(a,minx) < least(b,maxx) AND greatest(c,miny) < least(d,maxy)
       AND greatest(a,minx)+greatest(c,miny) < maxx+maxy-cut THEN 'INTERSECTS' ELSE 'NONE' END AS class
FROM (SELECT query_id, minx AS a, miny AS c, maxx AS b, maxy AS d FROM map_queries) q
JOIN boxes ON n_nationkey = query_id%25
UNION ALL SELECT event_id AS query_id, 'CONTAINS' AS class FROM event_points""")
def coverage_classify(t: Inputs):
    polygons = cut_coverages(t).select(F.col("coverage").alias("n_nationkey"), "polygon")
    q = box_of(t.map_queries).withColumn("n_nationkey", (F.col("query_id") % 25).cast("int"))
    polygons = polygons.withColumn("edges", geo.polygon_edges(F.col("polygon")))
    classified = q.join(polygons, "n_nationkey").select(
        "query_id", geo.classify_in_edges(F.col("edges"), F.col("box")).alias("class"))
    # requests without a coverage count as contained
    lon, lat = F.col("lon"), F.col("lat")
    uncovered = t.event_points.select(
        F.col("event_id").alias("query_id"),
        geo.classify_in_polygon(F.lit(None).cast("array<array<struct<x:double,y:double>>>"),
                                geo.bbox(lon, lat, lon + 1, lat + 1)).alias("class"))
    return classified.unionByName(uncovered)


@plan("points_in_coverage", "F2", """
SELECT event_id, n_nationkey AS coverage FROM event_points, boxes
WHERE lon >= minx AND lon < maxx AND lat >= miny AND lat < maxy AND lon+lat < maxx+maxy-cut""")
def points_in_coverage(t: Inputs):
    return cov.points_in_coverages(t.event_points, cut_coverages(t), GEODETIC, "lon", "lat", salts=4).select(
        "event_id", "coverage")


@plan("affected_tiles", "J1", """
WITH q AS (SELECT *, cast(query_id%8 AS int) AS z FROM map_queries),
s AS (SELECT *, 360e0/pow(2e0,z) AS span, cast(pow(2e0,z) AS bigint) AS w, cast(greatest(pow(2e0,z)/2e0,1e0) AS bigint) AS h FROM q),
r AS (SELECT query_id, z,
  greatest(cast(floor((minx+180e0)/span+1e-9) AS bigint),0) AS x0, greatest(cast(floor((miny+90e0)/span+1e-9) AS bigint),0) AS y0,
  least(cast(ceil((maxx+180e0)/span-1e-9)-1 AS bigint), w-1) AS x1, least(cast(ceil((maxy+90e0)/span-1e-9)-1 AS bigint), h-1) AS y1 FROM s)
SELECT query_id, z, x, y FROM r, range(128) a(x), range(64) b(y) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1""")
def affected_tiles(t: Inputs):
    q = box_of(t.map_queries).select("query_id", "box", (F.col("query_id") % 8).cast("int").alias("z"))
    return cov.affected_tiles(q, GEODETIC).select("query_id", "z", "x", "y")


@plan("tiles_by_coverage", "J2", f"""
WITH p AS (SELECT event_id, cast(event_id%7 AS int) AS z, lon, lat FROM event_points),
k AS (SELECT DISTINCT z, cast(floor((lon+180e0)/(360e0/pow(2e0,z))) AS bigint) AS x,
        cast(floor((lat+90e0)/(360e0/pow(2e0,z))) AS bigint) AS y FROM p),
g AS ({GEO_TILES})
SELECT z, x, y, n_nationkey AS coverage, CASE WHEN {CUT_INSIDE} THEN 'CONTAINS' ELSE 'INTERSECTS' END AS class
FROM k JOIN g USING (z, x, y), boxes WHERE {CUT_TOUCH}""")
def tiles_by_coverage(t: Inputs):
    z = (F.col("event_id") % 7).cast("int")
    tiles = t.event_points.select(
        z.alias("z"), GEODETIC.tile_x(F.col("lon"), z).alias("x"), GEODETIC.tile_y(F.col("lat"), z).alias("y")).distinct()
    return cov.join_coverages(tiles, cut_coverages(t), GEODETIC, depth=4, salts=2).select(
        "z", "x", "y", "coverage", F.col("coverage_class").alias("class"))


@plan("tile_count_plan", "A1", f"""
WITH g AS ({GEO_TILES})
SELECT n_nationkey AS coverage, z, count(*) AS tiles FROM g, boxes WHERE {CUT_TOUCH} GROUP BY 1, 2""")
def tile_count_plan(t: Inputs):
    return cov.count_tiles(cut_coverages(t), GEODETIC, 7).withColumn("z", F.col("z").cast("long"))


@plan("tile_count_boxes", "A1", f"""
WITH g AS ({GEO_TILES})
SELECT n_nationkey AS coverage, z, count(*) AS tiles FROM g, boxes
WHERE greatest(a,minx) < least(b,maxx) AND greatest(c,miny) < least(d,maxy) GROUP BY 1, 2""")
def tile_count_boxes(t: Inputs):
    levelled = box_coverages(t).withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(6))))
    return cov.count_box_tiles(levelled, GEODETIC).select(
        "coverage", F.col("z").cast("long").alias("z"), F.col("n_tiles").alias("tiles"))


def _parts(t: Inputs, z: int):
    tiles = cov.affected_tiles(box_coverages(t).withColumn("z", F.lit(z)), GEODETIC, spread=True)
    return tiles.select("coverage", "n_regionkey", "z", "x", "y")


NATION_TILES = f"""
 g AS ({GEO_TILES}),
 nt AS (SELECT n_nationkey, n_regionkey, x, y FROM g, boxes
        WHERE z = 5 AND greatest(a,minx) < least(b,maxx) AND greatest(c,miny) < least(d,maxy))"""


@plan("coverage_union", "U1", f"WITH {NATION_TILES} SELECT DISTINCT n_regionkey, x, y FROM nt")
def coverage_union(t: Inputs):
    parts = _parts(t, 5).withColumnRenamed("coverage", "part").withColumn("n_parts", F.lit(1))
    return cov.combine_tile_sets(parts, ["n_regionkey"], "union").select("n_regionkey", "x", "y")


@plan("coverage_intersection", "U2", f"""
WITH {NATION_TILES},
a AS (SELECT DISTINCT n_regionkey, x, y FROM nt),
b AS (SELECT DISTINCT (n_regionkey+4)%5 AS n_regionkey, x, y FROM nt)
SELECT * FROM a INTERSECT SELECT * FROM b""")
def coverage_intersection(t: Inputs):
    mine = _parts(t, 5).withColumn("part", F.lit(0))
    other = _parts(t, 5).withColumn("part", F.lit(1)).withColumn("n_regionkey", (F.col("n_regionkey") + 4) % 5)
    parts = mine.unionByName(other).withColumn("n_parts", F.lit(2))
    return cov.combine_tile_sets(parts, ["n_regionkey"], "intersection").select("n_regionkey", "x", "y")


@plan("coverage_difference", "U3", f"""
WITH {NATION_TILES},
a AS (SELECT DISTINCT n_regionkey, x, y FROM nt),
b AS (SELECT DISTINCT (n_regionkey+4)%5 AS n_regionkey, x, y FROM nt)
SELECT * FROM a EXCEPT SELECT * FROM b""")
def coverage_difference(t: Inputs):
    mine = _parts(t, 5).withColumn("part", F.lit(0))
    other = _parts(t, 5).withColumn("part", F.lit(1)).withColumn("n_regionkey", (F.col("n_regionkey") + 4) % 5)
    parts = mine.unionByName(other).withColumn("n_parts", F.lit(2))
    return cov.combine_tile_sets(parts, ["n_regionkey"], "difference").select("n_regionkey", "x", "y")


@plan("expire_list_coverage", "A17", """
WITH e AS (SELECT DISTINCT cast(2+event_id%6 AS int) AS z,
     x*4 >> cast(4-event_id%6+0 AS int) AS x, y*4 >> cast(4-event_id%6+0 AS int) AS y
     FROM tile_requests WHERE event_id%6 <= 4 UNION
     SELECT DISTINCT cast(7 AS int), x*8+3, y*8+5 FROM tile_requests WHERE event_id%6 > 4)
SELECT z, x, y FROM e WHERE NOT EXISTS (
  SELECT 1 FROM e u WHERE u.z < e.z AND u.x = (e.x >> (e.z-u.z)) AND u.y = (e.y >> (e.z-u.z))
)""")
def expire_list_coverage(t: Inputs):
    # an expire list of mixed levels 2..7 around the requested tiles
    level = (F.col("event_id") % 6 + 2).cast("int")
    listed = t.tile_requests.select(
        level.alias("z"),
        F.when(level == 7, F.col("x") * 8 + 3).otherwise(
            F.call_function("shiftright", F.col("x") * 4, F.greatest(F.lit(6) - level, F.lit(0)))).alias("x"),
        F.when(level == 7, F.col("y") * 8 + 5).otherwise(
            F.call_function("shiftright", F.col("y") * 4, F.greatest(F.lit(6) - level, F.lit(0)))).alias("y"))
    return cov.compact_tiles(listed, min_zoom=2)


CLIP = """
WITH q AS (SELECT query_id, q.minx, q.miny, q.maxx, q.maxy, width, height,
    b.minx AS a, b.miny AS c, b.maxx AS b, b.maxy AS d FROM map_queries q JOIN boxes b ON n_nationkey = query_id%25),
r AS (SELECT *, minx >= a AND maxx <= b AND miny >= c AND maxy <= d AS inside,
    minx < b AND maxx > a AND miny < d AND maxy > c AS touching,
    CASE WHEN a > minx THEN trunc((a-minx)*width/(maxx-minx)) ELSE 0 END AS l,
    CASE WHEN b < maxx THEN trunc((b-minx)*width/(maxx-minx)) ELSE width END AS r,
    CASE WHEN c > miny THEN trunc((maxy-c)*height/(maxy-miny)) ELSE height END AS o,
    CASE WHEN d < maxy THEN trunc((maxy-d)*height/(maxy-miny)) ELSE 0 END AS u FROM q)"""


@plan("extent_clip", "F5", CLIP + """
SELECT query_id, CASE WHEN inside THEN 'whole' WHEN NOT touching OR r-l = 0 OR o-u = 0 THEN 'empty' ELSE 'partial' END AS outcome,
  CASE WHEN touching AND NOT inside THEN cast(abs(r-l) AS bigint) END AS sub_w,
  CASE WHEN touching AND NOT inside THEN cast(abs(o-u) AS bigint) END AS sub_h,
  CASE WHEN touching AND NOT inside THEN cast(l AS bigint) END AS off_x,
  CASE WHEN touching AND NOT inside THEN cast(u AS bigint) END AS off_y,
  CASE WHEN touching AND NOT inside THEN greatest(minx,a) END AS sub_minx,
  CASE WHEN touching AND NOT inside THEN least(maxy,d) END AS sub_maxy FROM r""")
def extent_clip(t: Inputs):
    return cov.clip_queries(queries_with_extent(t)).select(
        "query_id", "outcome", F.col("sub.width").alias("sub_w"), F.col("sub.height").alias("sub_h"),
        F.col("sub.off_x").alias("off_x"), F.col("sub.off_y").alias("off_y"),
        F.col("sub.bbox.minx").alias("sub_minx"), F.col("sub.bbox.maxy").alias("sub_maxy"))


@plan("tile_limit_guard", "F7", """
WITH s AS (SELECT *, 360e0/pow(2e0,7) AS span FROM map_queries),
r AS (SELECT query_id,
  (least(cast(ceil((maxx+180e0)/span-1e-9)-1 AS bigint), 127) - greatest(cast(floor((minx+180e0)/span+1e-9) AS bigint),0) + 1) *
  (least(cast(ceil((maxy+90e0)/span-1e-9)-1 AS bigint), 63) - greatest(cast(floor((miny+90e0)/span+1e-9) AS bigint),0) + 1) AS n_tiles FROM s)
SELECT query_id, n_tiles, CASE WHEN n_tiles >= 12 THEN 'refused' ELSE 'served' END AS verdict FROM r""")
def tile_limit_guard(t: Inputs):
    q = box_of(t.map_queries).select("query_id", "box", F.lit(7).alias("z"))
    served, refused = cov.within_tile_limit(cov.tile_ranges(q, GEODETIC), 12)
    return served.withColumn("verdict", F.lit("served")).unionByName(
        refused.withColumn("verdict", F.lit("refused"))).select("query_id", "n_tiles", "verdict")


@plan("tile_aligned", "F8", """
WITH r AS (SELECT q.event_id, value, 360e0/16e0/256e0 AS res, x*22.5e0-180e0 AS a
           FROM tile_requests q JOIN events e ON q.event_id = e.event_id)
SELECT event_id, abs(a - (a+value*res/100e0)) <= abs(22.5e0/256e0/10e0) AS aligned FROM r""")
def tile_aligned(t: Inputs):
    # the asked box is the tile's own, shifted by a fraction of a pixel
    r = t.tile_requests.join(t.events.select("event_id", "value"), "event_id").withColumn(
        "y", F.floor(F.col("y") / 2).cast("long"))
    tile = cov.tile_box(GEODETIC)
    r = r.withColumn("tile", tile)
    shift = F.col("value") * (360.0 / 16 / 256) / 100
    asked = geo.bbox(F.col("tile.minx") + shift, F.col("tile.miny"), F.col("tile.maxx") + shift, F.col("tile.maxy"))
    return r.withColumn("asked", asked).select("event_id", cov.tile_aligned(
        F.col("asked"), F.col("tile"), F.lit(256), F.lit(256)).alias("aligned"))


@plan("buffered_bbox", "P12", """
WITH q AS (SELECT *, 360e0/256e0/pow(2e0, query_id%10) AS res, query_id%7*30-30 AS px FROM map_queries)
SELECT query_id,
  CASE WHEN px > 0 THEN greatest(minx-px*res, -180e0) ELSE minx END AS minx,
  CASE WHEN px > 0 THEN greatest(miny-px*res, -90e0) ELSE miny END AS miny,
  CASE WHEN px > 0 THEN least(maxx+px*res, 180e0) ELSE maxx END AS maxx,
  CASE WHEN px > 0 THEN least(maxy+px*res, 90e0) ELSE maxy END AS maxy FROM q""")
def buffered_bbox_plan(t: Inputs):
    grown = buffered_bbox(GEODETIC, *[F.col(c) for c in SIDES], (F.col("query_id") % 10).cast("int"),
                          F.col("query_id") % 7 * 30 - 30)
    return t.map_queries.withColumn("grown", grown).select(
        "query_id", *[F.col(f"grown.{c}").alias(c) for c in SIDES])


@plan("pixel_to_coord", "P13", """
WITH q AS (SELECT *, query_id%width AS px, query_id*7%height AS py FROM map_queries)
SELECT query_id, px, py, minx + px*(maxx-minx)/width AS x, miny + (height-py)*(maxy-miny)/height AS y,
  cast(trunc((minx+1.5e0-minx)/(maxx-minx)*width) AS bigint) AS off_x,
  cast(trunc((maxy-(maxy-0.75e0))/(maxy-miny)*height) AS bigint) AS off_y FROM q""")
def pixel_to_coord(t: Inputs):
    q = box_of(t.map_queries)
    px, py = F.col("query_id") % F.col("width"), F.col("query_id") * 7 % F.col("height")
    box, w, h = F.col("box"), F.col("width"), F.col("height")
    inner = geo.bbox(box.minx + 1.5, box.miny, box.maxx, box.maxy - 0.75)
    q = q.withColumn("px", px).withColumn("py", py).withColumn("inner", inner)
    at = geo.pixel_to_coord(F.col("px"), F.col("py"), w, h, box)
    off = geo.tile_offset(box, w, h, F.col("inner"))
    return q.select("query_id", "px", "py", at.x.alias("x"), at.y.alias("y"),
                    off.off_x.alias("off_x"), off.off_y.alias("off_y"))


@plan("axis_order_switch", "P16", """
SELECT query_id, srs,
  CASE WHEN srs IN ('EPSG:4326','EPSG:4258','EPSG:31466','EPSG:31467','EPSG:31468') THEN miny ELSE minx END AS minx,
  CASE WHEN srs IN ('EPSG:4326','EPSG:4258','EPSG:31466','EPSG:31467','EPSG:31468') THEN minx ELSE miny END AS miny,
  CASE WHEN srs IN ('EPSG:4326','EPSG:4258','EPSG:31466','EPSG:31467','EPSG:31468') THEN maxy ELSE maxx END AS maxx,
  CASE WHEN srs IN ('EPSG:4326','EPSG:4258','EPSG:31466','EPSG:31467','EPSG:31468') THEN maxx ELSE maxy END AS maxy
FROM map_queries""")
def axis_order_switch(t: Inputs):
    q = box_of(t.map_queries).withColumn("box", geo.swap_axes(F.col("srs"), F.col("box")))
    return q.select("query_id", "srs", *[F.col(f"box.{c}").alias(c) for c in SIDES])


MX = "radians({0})*6378137e0"
MY = "ln(tan(pi()/4e0+radians({0})/2e0))*6378137e0"


@plan("reproject_points", "P17", f"""
WITH v AS (SELECT event_id, 0 AS k, lon AS x, lat AS y FROM event_points
  UNION ALL SELECT event_id, 1, lon*0.9e0, lat FROM event_points UNION ALL SELECT event_id, 2, lon*0.9e0, lat*0.9e0 FROM event_points)
SELECT event_id, cast(k AS int) AS k, round({MX.format('x')}, 3) AS mx, round({MY.format('y')}, 3) AS my,
  round(x, 6) AS lon, round(y, 6) AS lat FROM v""")
def reproject_points(t: Inputs):
    lon, lat = F.col("lon"), F.col("lat")
    parts = F.array(F.array(F.array(
        geo.vertex(lon, lat), geo.vertex(lon * 0.9, lat), geo.vertex(lon * 0.9, lat * 0.9))))
    df = t.event_points.select("event_id", geo.reproject_parts(parts, "EPSG:4326", "EPSG:3857").alias("m"))
    df = df.withColumn("back", geo.reproject_parts(F.col("m"), "EPSG:900913", "EPSG:4326"))
    both = F.arrays_zip(F.flatten(F.flatten("m")).alias("m"), F.flatten(F.flatten("back")).alias("g"))
    return df.select("event_id", F.posexplode(both).alias("k", "v")).select(
        "event_id", "k", F.round("v.m.x", 3).alias("mx"), F.round("v.m.y", 3).alias("my"),
        F.round("v.g.x", 6).alias("lon"), F.round("v.g.y", 6).alias("lat"))


@plan("reproject_bbox", "P18", f"""
WITH e AS (SELECT query_id, minx+(maxx-minx)*i/16e0 AS x, CASE WHEN s=0 THEN miny ELSE maxy END AS y FROM map_queries, range(17) a(i), range(2) b(s)
  UNION ALL SELECT query_id, CASE WHEN s=0 THEN minx ELSE maxx END, miny+(maxy-miny)*i/16e0 FROM map_queries, range(17) a(i), range(2) b(s))
SELECT query_id, round(min({MX.format('x')}),3) AS minx, round(min({MY.format('y')}),3) AS miny,
  round(max({MX.format('x')}),3) AS maxx, round(max({MY.format('y')}),3) AS maxy FROM e GROUP BY 1""")
def reproject_bbox(t: Inputs):
    box = geo.reproject_bbox(geo.bbox(*[F.col(c) for c in SIDES]), "EPSG:4326", "EPSG:3857")
    return t.map_queries.withColumn("m", box).select(
        "query_id", *[F.round(F.col(f"m.{c}"), 3).alias(c) for c in SIDES])


def coverage_texts(t: Inputs):
    """Each nation's cut box written as text: half of them well-known text, the others GeoJSON, one in three multipart."""
    c, k = F.col, F.col("n_nationkey")
    ring = [(c("minx"), c("miny")), (c("maxx"), c("miny")), (c("maxx"), c("maxy") - c("cut")), (c("maxx") - c("cut"), c("maxy")), (c("minx"), c("maxy")),
            (c("minx"), c("miny"))]
    far = [(c("minx") - 2, c("miny")), (c("minx") - 1, c("miny")), (c("minx") - 1, c("miny") + 1), (c("minx") - 2, c("miny"))]

    def wkt(points):
        return F.concat(F.lit("("), F.concat_ws(", ", *[F.concat_ws(" ", x, y) for x, y in points]), F.lit(")"))

    def geojson(points):
        return F.concat(F.lit("["), F.concat_ws(",", *[F.concat(F.lit("["), F.concat_ws(",", x, y), F.lit("]")) for x, y in points]), F.lit("]"))

    as_wkt = F.when(k % 3 == 0, F.concat(F.lit("MULTIPOLYGON(("), wkt(ring), F.lit("), ("), wkt(far), F.lit("))"))).otherwise(
        F.concat(F.lit("POLYGON ("), wkt(ring), F.lit(")")))
    as_json = F.when(k % 3 == 0, F.concat(F.lit('{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[['), geojson(ring), F.lit("],["), geojson(far),
                                          F.lit("]]}}"))).otherwise(F.concat(F.lit('{"type":"Polygon","coordinates":['), geojson(ring), F.lit("]}")))
    return t.boxes.select(k.alias("coverage"), F.when(k % 2 == 0, as_wkt).otherwise(as_json).alias("text"))


@plan("coverage_from_wkt", "F1", """
SELECT n_nationkey AS coverage, CASE WHEN n_nationkey%3=0 THEN 2 ELSE 1 END AS rings,
  CASE WHEN n_nationkey%3=0 THEN minx-2e0 ELSE minx END AS minx, miny, maxx, maxy,
  (SELECT count(*) FROM event_points WHERE (lon >= minx AND lon < maxx AND lat >= miny AND lat < maxy AND lon+lat < maxx+maxy-cut)
     OR (n_nationkey%3=0 AND lat >= miny AND lat < lon-minx+2e0+miny AND lon < minx-1e0)) AS points
FROM boxes""")
def coverage_from_wkt(t: Inputs):
    read = coverage_texts(t).withColumn("polygon", F.coalesce(texts.polygon_from_wkt(F.col("text")), texts.polygon_from_geojson(F.col("text"))))
    read = read.withColumn("box", texts.polygon_box(F.col("polygon"))).drop("text")
    inside = cov.points_in_coverages(t.event_points, read, GEODETIC, "lon", "lat", salts=4).groupBy(F.col("coverage").alias("_c")).agg(
        F.count(F.lit(1)).alias("points"))
    return read.join(inside, F.col("coverage") == F.col("_c"), "left").select(
        "coverage", F.size("polygon").alias("rings"), "box.*", F.coalesce("points", F.lit(0).cast("long")).alias("points"))


@plan("coverage_expression", "U1 U2 U3", """
WITH q AS (SELECT query_id, m.minx AS a, m.miny AS c, m.maxx AS b, m.maxy AS d, x.minx AS x0, x.miny AS y0, x.maxx AS x1, x.maxy AS y1
  FROM map_queries m JOIN boxes x ON n_nationkey = query_id%25),
s AS (SELECT query_id, CASE WHEN a>=x0 AND b<=x1 AND c>=y0 AND d<=y1 THEN 2 WHEN a<x1 AND b>x0 AND c<y1 AND d>y0 THEN 1 ELSE 0 END AS one,
  CASE WHEN a>=x0+30e0 AND b<=x1+60e0 AND c>=y0 AND d<=y1+20e0 THEN 2 WHEN a<x1+60e0 AND b>x0+30e0 AND c<y1+20e0 AND d>y0 THEN 1 ELSE 0 END AS two,
  CASE WHEN a>=-60e0 AND b<=60e0 AND c>=-40e0 AND d<=40e0 THEN 2 WHEN a<60e0 AND b>-60e0 AND c<40e0 AND d>-40e0 THEN 1 ELSE 0 END AS three FROM q),
u AS (SELECT query_id, greatest(one, two) AS both_, three FROM s)
SELECT query_id, CASE WHEN both_=0 OR three=2 THEN 'NONE' WHEN both_=2 AND three=0 THEN 'CONTAINS' ELSE 'INTERSECTS' END AS without,
  CASE least(both_, three) WHEN 0 THEN 'NONE' WHEN 1 THEN 'INTERSECTS' ELSE 'CONTAINS' END AS within FROM u""")
def coverage_expression(t: Inputs):
    q = queries_with_extent(t)
    e = F.col("extent")
    moved = geo.bbox(e.minx + 30, e.miny, e.maxx + 60, e.maxy + 20)
    both = ("union", (e, None), (moved, None))
    middle = (geo.bbox(-60, -40, 60, 40), None)
    return q.select("query_id", texts.expression_class(("difference", both, middle), F.col("box")).alias("without"),
                    texts.expression_class(("intersection", both, middle), F.col("box")).alias("within"))


@plan("boxes_off_the_grid", "J1 A1", """
WITH b AS (SELECT o_orderkey AS task, (o_orderkey*137.508e0)%900e0-450e0 AS minx, (o_orderkey*61.8034e0)%400e0-200e0 AS miny FROM orders),
r AS (SELECT task, greatest(cast(floor((minx+180e0)/11.25e0+1e-9) AS bigint), 0) AS x0, least(cast(ceil((minx+210e0)/11.25e0-1e-9) AS bigint)-1, 31) AS x1,
  greatest(cast(floor((miny+90e0)/11.25e0+1e-9) AS bigint), 0) AS y0, least(cast(ceil((miny+110e0)/11.25e0-1e-9) AS bigint)-1, 15) AS y1 FROM b)
SELECT task, CASE WHEN x0 <= x1 AND y0 <= y1 THEN (x1-x0+1)*(y1-y0+1) ELSE 0 END AS n_tiles FROM r""")
def boxes_off_the_grid(t: Inputs):
    key = F.col("o_orderkey")
    minx, miny = key * 137.508 % 900.0 - 450.0, key * 61.8034 % 400.0 - 200.0
    boxes = t.orders.select(key.alias("task"), geo.bbox(minx, miny, minx + 30, miny + 20).alias("box"), F.lit(5).alias("z"))
    counted = cov.count_box_tiles(boxes, GEODETIC).select("task", "n_tiles")
    # as many tiles are there when the ranges are walked
    walked = cov.affected_tiles(boxes, GEODETIC, spread=True).groupBy(F.col("task").alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    return counted.join(walked, F.col("task") == F.col("_t"), "left").select(
        "task", F.when(F.col("n_tiles") == F.coalesce("_n", F.lit(0)), F.col("n_tiles")).alias("n_tiles"))
