"""Cache state, tasks, tileset metadata and time handling."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilespark.functions import formats, requests as req, tilemath
from tilespark.functions.tilemath import GEODETIC, MERC_LIMIT, MERCATOR, WEBMERCATOR, Grid
from tilespark.operators import cache_state as cs
from tilespark.operators import catalog, coverage as cov, ordering
from tilespark.plans.coverage_plans import box_coverages
from tilespark.plans.inputs import Inputs
from tilespark.plans.registry import plan
from tilespark.sources import manifest



def expire():
    return F.lit("1998-06-01").cast("timestamp_ntz")


STORE = """store AS (
  SELECT z, x, y, arg_max(mtime, (mtime, o_orderkey)) AS mtime, arg_max(size, (mtime, o_orderkey)) AS size
  FROM tile_store GROUP BY z, x, y)"""


def current_store(t: Inputs):
    """The derived store holds several writes per tile; the last one counts."""
    return cs.latest(t.tile_store.select("z", "x", "y", "mtime", "size", "o_orderkey"), order=("mtime", "o_orderkey"))


@plan("tile_heat_cache_state", "P2 J3 J4 A6 W5", f"""
WITH {STORE},
heat AS (SELECT z, x, y, count(*) AS requests, count(*) FILTER (WHERE event_type='error') AS errors FROM tile_requests GROUP BY 1,2,3)
SELECT z, x, y, requests, errors, CASE WHEN mtime IS NULL THEN 'miss' WHEN mtime < TIMESTAMP '1998-06-01' THEN 'stale' ELSE 'hit' END AS state
FROM heat LEFT JOIN store USING (z, x, y)""")
def tile_heat_cache_state(t: Inputs):
    return cs.request_heat(t.tile_requests, t.tile_store, expire())


@plan("last_write_wins", "W5", """
SELECT tileset, z, x, y, epoch_us(max(mtime)) AS mtime_us, arg_max(size, (mtime, o_orderkey)) AS size,
  arg_max(o_orderkey, (mtime, o_orderkey)) AS o_orderkey
FROM tile_store GROUP BY tileset, z, x, y""")
def last_write_wins(t: Inputs):
    last = cs.latest(t.tile_store, ("tileset", "z", "x", "y"), ("mtime", "o_orderkey"))
    return last.select("tileset", "z", "x", "y", F.unix_micros(F.col("mtime").cast("timestamp")).alias("mtime_us"),
                       "size", "o_orderkey")


# a deeper, sparse store: one tile per order
SPARSE = "s AS (SELECT o_orderstatus AS tileset, cast(9 AS int) AS z, (o_custkey*37+o_orderkey%3)%512 AS x, o_orderkey*11%512 AS y, o_orderdate AS mtime, o_orderkey FROM orders)"


def sparse_store(t: Inputs):
    return t.orders.select(
        F.col("o_orderstatus").alias("tileset"), F.lit(9).alias("z"),
        ((F.col("o_custkey") * 37 + F.col("o_orderkey") % 3) % 512).alias("x"),
        (F.col("o_orderkey") * 11 % 512).alias("y"), F.col("o_orderdate").alias("mtime"), "o_orderkey")


def deep_requests(t: Inputs):
    n = F.lit(9)
    return t.event_points.select(
        "event_id", n.alias("z"), tilemath.lonlat_to_tile_x(F.col("lon"), n).alias("x"),
        tilemath.lonlat_to_tile_y(F.col("lat"), n).alias("y"))


DEEP = """w AS (SELECT event_id, cast(9 AS int) AS z, cast(floor((lon+180e0)/360e0*512e0) AS bigint) AS x,
  cast(floor((1e0-ln(tan(radians(lat))+1e0/cos(radians(lat)))/pi())/2e0*512e0) AS bigint) AS y FROM event_points)"""


@plan("uncached_tiles", "J3", f"""
WITH {SPARSE}, {DEEP} SELECT DISTINCT z, x, y FROM w WHERE NOT EXISTS (
  SELECT 1 FROM s WHERE s.x = w.x AND s.y = w.y AND s.z = w.z)""")
def uncached_tiles(t: Inputs):
    return cs.missing(cs.distinct_tiles(deep_requests(t)).select("z", "x", "y"), sparse_store(t))


@plan("stale_and_fresh_tiles", "J4", f"""
WITH {SPARSE}, {DEEP},
c AS (SELECT z, x, y, max(mtime) AS mtime FROM s GROUP BY 1,2,3)
SELECT z, x, y, CASE WHEN mtime < TIMESTAMP '1998-06-01' THEN 'stale' ELSE 'fresh' END AS state
FROM c WHERE (z, x, y) IN (SELECT (z, x, y) FROM w)""")
def stale_and_fresh_tiles(t: Inputs):
    stored = sparse_store(t).groupBy("z", "x", "y").agg(F.max("mtime").alias("mtime"))
    wanted = deep_requests(t)
    old = cs.stale(stored, wanted, expire()).withColumn("state", F.lit("stale"))
    new = cs.fresh(stored, wanted, expire()).withColumn("state", F.lit("fresh"))
    return old.unionByName(new).select("z", "x", "y", "state")


@plan("import_merge", "J14", f"""
WITH {SPARSE}, {DEEP},
st AS (SELECT z, x, y, max(o_orderkey) AS payload FROM s GROUP BY 1,2,3),
im AS (SELECT z, x, y, max(event_id)+1000000 AS payload FROM w GROUP BY 1,2,3)
SELECT 'force' AS mode, z, x, y, coalesce(im.payload, st.payload) AS payload FROM st FULL JOIN im USING (z,x,y)
UNION ALL
SELECT 'fill', z, x, y, coalesce(st.payload, im.payload) FROM st FULL JOIN im USING (z,x,y)""")
def import_merge(t: Inputs):
    stored = sparse_store(t).groupBy("z", "x", "y").agg(F.max("o_orderkey").alias("payload"))
    imported = deep_requests(t).groupBy("z", "x", "y").agg((F.max("event_id") + 1000000).alias("payload"))
    forced = cs.merge_import(stored, imported, True).withColumn("mode", F.lit("force"))
    filled = cs.merge_import(stored, imported, False).withColumn("mode", F.lit("fill"))
    return forced.unionByName(filled).select("mode", "z", "x", "y", "payload")


@plan("cleanup", "U4", f"""
WITH {STORE},
g AS (SELECT DISTINCT x, y FROM range(16) a(x), range(8) b(y), boxes
  WHERE greatest(x*22.5e0-180e0, minx) < least((x+1)*22.5e0-180e0, maxx) AND greatest(y*22.5e0-90e0, miny) < least((y+1)*22.5e0-90e0, maxy))
SELECT z, x, y, size FROM store WHERE NOT (mtime < TIMESTAMP '2000-01-01' AND (x, y) IN (SELECT (x, y) FROM g))""")
def cleanup(t: Inputs):
    doomed = cov.affected_tiles(box_coverages(t).withColumn("z", F.lit(4)), GEODETIC, spread=True)
    kept = cs.cleanup(current_store(t), doomed, F.lit("2000-01-01").cast("timestamp_ntz"))
    return kept.select("z", "x", "y", "size")


@plan("processed_tile_dedupe", "W1", """
SELECT z, x, y, count(*) AS visits FROM (SELECT DISTINCT z, x - x%4 AS x, y - y%4 AS y, layer FROM tile_requests) GROUP BY 1,2,3""")
def processed_tile_dedupe(t: Inputs):
    from tilespark.operators.tiling import meta_tiles

    once = cs.distinct_tiles(meta_tiles(t.tile_requests, 4), ("z", "mx", "my", "layer"))
    return once.groupBy("z", F.col("mx").alias("x"), F.col("my").alias("y")).agg(F.count(F.lit(1)).alias("visits"))


@plan("resume_point", "W6", """
SELECT o_orderkey, CASE
  WHEN o_custkey%5 = 0 THEN false WHEN o_custkey%5 = 1 THEN true
  WHEN a1 <> b1 THEN a1 > b1 WHEN o_custkey%5 = 2 THEN false
  WHEN a2 <> b2 THEN a2 > b2 ELSE false END AS skip
FROM (SELECT o_orderkey, o_custkey, o_custkey%4 AS a1, o_custkey%7 AS a2, o_orderkey%4 AS b1, o_orderkey%7 AS b2 FROM orders)""")
def resume_point(t: Inputs):
    cust, order = F.col("o_custkey"), F.col("o_orderkey")

    def step(i, n):
        return F.struct(i.alias("i"), F.lit(n).alias("n"))

    one, two = F.array(step(cust % 4, 4)), F.array(step(cust % 4, 4), step(cust % 7, 7))
    empty = F.filter(one, lambda s: F.lit(False))
    old = F.when(cust % 5 == 0, None).when(cust % 5 == 1, empty).when(cust % 5 == 2, one).otherwise(two)
    current = F.array(step(order % 4, 4), step(order % 7, 7))
    df = t.orders.select("o_orderkey", old.alias("old"), current.alias("current"))
    return df.select("o_orderkey", cs.can_skip(F.col("old"), F.col("current")).alias("skip"))


@plan("running_progress", "W8", """
WITH n AS (SELECT layer, z, y, x, count(*) AS tiles FROM tile_requests GROUP BY 1,2,3,4)
SELECT layer, z, y, x, tiles, cast(sum(tiles) OVER (PARTITION BY layer ORDER BY z, y, x) AS bigint) AS done FROM n""")
def running_progress(t: Inputs):
    n = t.tile_requests.groupBy("layer", "z", "y", "x").agg(F.count(F.lit(1)).alias("tiles"))
    return ordering.running_total(n, ["layer"], F.struct("z", "y"), ["x"], F.col("tiles"), "done")


@plan("tileset_metadata", "A2", f"""
WITH {SPARSE},
u AS (SELECT tileset, z, x, y FROM s UNION ALL SELECT tileset, z, x, y FROM tile_store),
b AS (SELECT tileset, z, x/pow(2e0,z)*360e0-180e0 AS minx, (x+1)/pow(2e0,z)*360e0-180e0 AS maxx,
  degrees(atan(sinh(pi()*(1e0-(y+1)*2e0/pow(2e0,z))))) AS miny, degrees(atan(sinh(pi()*(1e0-y*2e0/pow(2e0,z))))) AS maxy FROM u),
m AS (SELECT tileset, min(z) AS min_zoom, max(z) AS max_zoom, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM b GROUP BY 1)
SELECT tileset, min_zoom, max_zoom, round(minx,6) AS minx, round(miny,6) AS miny, round(maxx,6) AS maxx, round(maxy,6) AS maxy,
  round((minx+maxx)/2e0,5) AS center_x, round((miny+maxy)/2e0,5) AS center_y, 'png' AS format, '2' AS res_factor FROM m""")
def tileset_metadata(t: Inputs):
    meta = catalog.tileset_metadata(sparse_store(t).select("tileset", "z", "x", "y").unionByName(t.tile_store.select("tileset", "z", "x", "y")))
    rounded = {c: F.round(c, 6) for c in ("minx", "miny", "maxx", "maxy")}
    rounded.update({c: F.round(c, 5) for c in ("center_x", "center_y")})
    return meta.withColumns(rounded)


@plan("availability_ranges", "A5", f"""
WITH {SPARSE},
d AS (SELECT DISTINCT tileset, z, x, y FROM s),
r AS (SELECT tileset, z, y, min(x) AS start_x, max(x) AS end_x FROM (
  SELECT *, x - row_number() OVER (PARTITION BY tileset, z, y ORDER BY x) AS g FROM d) GROUP BY tileset, z, y, g)
SELECT tileset, z, start_x, end_x, min(y) AS start_y, max(y) AS end_y FROM (
  SELECT *, y - row_number() OVER (PARTITION BY tileset, z, start_x, end_x ORDER BY y) AS g FROM r)
GROUP BY tileset, z, start_x, end_x, g""")
def availability_ranges(t: Inputs):
    return catalog.availability(sparse_store(t)).select("tileset", "z", "start_x", "end_x", "start_y", "end_y")


@plan("task_progress", "A7", """
SELECT o_custkey AS task, count(*) FILTER (WHERE o_orderstatus='F') AS completed, count(*) AS total,
  round(count(*) FILTER (WHERE o_orderstatus='F')/count(*), 6) AS progress,
  (epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate)))//1000 AS duration_ms FROM orders GROUP BY 1""")
def task_progress(t: Inputs):
    p = catalog.task_progress(t.orders.withColumnRenamed("o_custkey", "task"), "task", F.col("o_orderstatus") == "F", "o_orderdate")
    ms = F.unix_millis(F.col("updated_at").cast("timestamp")) - F.unix_millis(F.col("start_time").cast("timestamp"))
    return p.select("task", "completed", "total", F.round("progress", 6).alias("progress"), ms.alias("duration_ms"))


@plan("grid_rekey", "J5", """
SELECT event_id, z AS nz, x AS nx, 15-y AS ny, cast(NULL AS bigint) AS n_tiles FROM tile_requests WHERE layer < 3
UNION ALL SELECT event_id, NULL, NULL, NULL, 2 FROM tile_requests WHERE layer = 3 AND x > 0
UNION ALL SELECT event_id, z, 0, y, NULL FROM tile_requests WHERE layer = 3 AND x = 0""")
def grid_rekey(t: Inputs):
    # layer 3 goes to a grid shifted by half a tile, where only the first column fits one tile
    half = MERC_LIMIT / 16
    shifted = Grid("shifted", "EPSG:3857", (-MERC_LIMIT + half, -MERC_LIMIT, MERC_LIMIT + half, MERC_LIMIT),
                   WEBMERCATOR.resolutions, origin="nw")
    src = t.tile_requests.select("event_id", "layer", "z", "x", "y")
    parts = []
    for rows, grid in ((src.filter("layer < 3"), MERCATOR), (src.filter("layer = 3"), shifted)):
        one, errors = cs.rekey(rows, WEBMERCATOR, grid)
        parts.append(one.select("event_id", "nz", "nx", "ny", F.lit(None).cast("long").alias("n_tiles")))
        parts.append(errors.select("event_id", F.lit(None).cast("int").alias("nz"), F.lit(None).cast("long").alias("nx"),
                                   F.lit(None).cast("long").alias("ny"), "n_tiles"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@plan("grid_overlap", "J6", f"""
WITH {STORE},
d AS (SELECT DISTINCT cast(3 AS int) AS z, cast(floor((lon+180e0)/45e0) AS bigint) AS x, cast(floor((lat+90e0)/45e0) AS bigint) AS y FROM event_points),
b AS (SELECT *, x*2 AS x0, x*2+1 AS x1,
  (1e0-ln(tan(radians(least(y*45e0-45e0, 85.05112877980659e0)))+1e0/cos(radians(least(y*45e0-45e0, 85.05112877980659e0))))/pi())/2e0*16e0 AS top,
  (1e0-ln(tan(radians(greatest(y*45e0-90e0, -85.05112877980659e0)))+1e0/cos(radians(greatest(y*45e0-90e0, -85.05112877980659e0))))/pi())/2e0*16e0 AS bottom FROM d),
r AS (SELECT *, greatest(cast(floor(top+1e-6) AS bigint),0) AS y0, least(cast(ceil(bottom-1e-6)-1 AS bigint),15) AS y1 FROM b)
SELECT r.x, r.y, s.x AS sx, s.y AS sy, (s.x-x0)*256 AS off_x, (s.y-y0)*256 AS off_y, size
FROM r JOIN store s ON s.x BETWEEN x0 AND x1 AND s.y BETWEEN y0 AND y1""")
def grid_overlap(t: Inputs):
    level = F.lit(3)
    targets = t.event_points.select(
        level.alias("z"), GEODETIC.tile_x(F.col("lon"), level).alias("x"), GEODETIC.tile_y(F.col("lat"), level).alias("y")).distinct()
    pairs = cs.overlap_tiles(targets, GEODETIC, WEBMERCATOR, F.lit(4))
    stored = current_store(t).select(F.col("z").alias("sz"), F.col("x").alias("sx"), F.col("y").alias("sy"), "size")
    return pairs.join(stored, ["sz", "sx", "sy"]).select("x", "y", "sx", "sy", "off_x", "off_y", "size")


@plan("rescale_fill", "J15", f"""
WITH {SPARSE}, {DEEP},
h AS (SELECT DISTINCT 9 AS z, x, y FROM s UNION SELECT 7, x>>2, y>>2 FROM s WHERE tileset='P' UNION SELECT 11, x*4+5, y*4+2 FROM s),
a AS (SELECT DISTINCT z, x, y FROM w),
f AS (
  SELECT a.x, a.y, 9 AS src_z, 1 AS n, 0 AS d FROM a JOIN h ON h.z=9 AND h.x=a.x AND h.y=a.y
  UNION ALL SELECT a.x, a.y, 7, 1, 2 FROM a JOIN h ON h.z=7 AND h.x=a.x>>2 AND h.y=a.y>>2
  UNION ALL SELECT a.x, a.y, 11, count(*), 3 FROM a JOIN h ON h.z=11 AND h.x>>2=a.x AND h.y>>2=a.y GROUP BY 1,2),
p AS (SELECT x, y, arg_min(src_z, d) AS src_z, arg_min(n, d) AS n_src FROM f GROUP BY 1,2)
SELECT a.x, a.y, cast(src_z AS int) AS src_z, cast(coalesce(n_src,0) AS bigint) AS n_src FROM a LEFT JOIN p ON p.x=a.x AND p.y=a.y""")
def rescale_fill(t: Inputs):
    s = sparse_store(t)
    held = s.select("z", "x", "y").unionByName(
        s.filter("tileset = 'P'").select(F.lit(7).alias("z"), F.shiftright("x", 2).alias("x"), F.shiftright("y", 2).alias("y"))
    ).unionByName(s.select(F.lit(11).alias("z"), (F.col("x") * 4 + 5).alias("x"), (F.col("y") * 4 + 2).alias("y")))
    wanted = deep_requests(t).select("z", "x", "y").distinct()
    return cs.nearest_levels(wanted, held, up=2, down=2).select("x", "y", "src_z", "n_src")


@plan("access_metrics", "A6", f"""
WITH {STORE},
j AS (SELECT service, layer, r.z, event_type='error' AS bad, coalesce(mtime >= TIMESTAMP '1998-06-01', false) AS hit
      FROM tile_requests r LEFT JOIN store USING (z, x, y))
SELECT service, layer, z, count(*) FILTER (WHERE hit AND NOT bad) AS hits, count(*) FILTER (WHERE NOT hit AND NOT bad) AS misses,
  count(*) FILTER (WHERE bad) AS errors, count(*) FILTER (WHERE NOT bad) AS requests
FROM j GROUP BY ROLLUP (service, layer, z)""")
def access_metrics(t: Inputs):
    return cs.access_metrics(t.tile_requests, t.tile_store, expire())


@plan("fetch_manifest", "S10", """
WITH k AS (SELECT DISTINCT z, x, cast(y//2 AS bigint) AS y FROM tile_requests)
SELECT z, x, y, concat('https://', CASE (x+y)%3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END, '.tiles.example.org/',
  cast(z AS varchar), '/', cast(x AS varchar), '/', cast(y AS varchar), '.png?q=',
  array_to_string([cast(((x >> cast(z-i-1 AS int)) & 1) + 2*((y >> cast(z-i-1 AS int)) & 1) AS varchar) for i in range(z)], ''),
  '&tc=', printf('%02d/%03d/%03d/%03d/%03d/%03d/%03d', z, x//1000000, x//1000%1000, x%1000, y//1000000, y//1000%1000, y%1000),
  '&tms=', printf('%d/%d/%d', z, x, y), '&a=', printf('L%02d/R%08x/C%08x', z, y, x),
  '&bbox=', printf('%.8f,%.8f,%.8f,%.8f', x*22.5e0-180e0, y*22.5e0-90e0, (x+1)*22.5e0-180e0, (y+1)*22.5e0-90e0),
  '&token=k1') AS url FROM k""")
def fetch_manifest(t: Inputs):
    missing = t.tile_requests.select("z", "x", F.floor(F.col("y") / 2).cast("long").alias("y")).distinct()
    template = ("https://{subdomains}.tiles.example.org/{z}/{x}/{y}.{format}?q={quadkey}&tc={tc_path}&tms={tms_path}"
                "&a={arcgiscache_path}&bbox={bbox}&token={access_token}")
    return manifest.fetch_manifest(missing, template, GEODETIC, "png", subdomains=("a", "b", "c"), access_token="k1")


DAYS = "'MonTueWedThuFriSatSun'"
MONTHS = "'JanFebMarAprMayJunJulAugSepOctNovDec'"
D2 = "lpad(cast(extract({0} FROM ts) AS varchar(9)),2,'0')"
# one clock text per event, in six forms by event_id % 6; the same text in both engines
CLOCK = f"""
SELECT event_id, ts, CASE event_id%6
  WHEN 0 THEN concat(yy, '-', mo, '-', dd, 'T', clock, 'Z')
  WHEN 1 THEN concat(yy, '-', mo, '-', dd, 'T', clock, '+02:00')
  WHEN 2 THEN concat(wd, ', ', dd, ' ', mn, ' ', yy, ' ', clock, ' GMT')
  WHEN 3 THEN concat(wd, 'day, ', dd, '-', mn, '-', substr(yy,3,2), ' ', clock, ' UTC')
  WHEN 4 THEN concat(wd, ' ', mn, ' ', lpad(d1,2,' '), ' ', clock, ' ', yy)
  ELSE concat(dd, '/', mo, '/', yy) END AS stamp
FROM (SELECT event_id, ts, cast(extract(year FROM ts) AS varchar(9)) AS yy, {D2.format('month')} AS mo, {D2.format('day')} AS dd,
  cast(extract(day FROM ts) AS varchar(9)) AS d1, substr({MONTHS}, cast(3*extract(month FROM ts)-2 AS int), 3) AS mn,
  substr({DAYS}, cast(3*((extract(doy FROM ts)-1)%7)+1 AS int), 3) AS wd,
  concat({D2.format('hour')}, ':', {D2.format('minute')}, ':', lpad(cast(cast(floor(extract(second FROM ts)) AS int) AS varchar(9)),2,'0')) AS clock
  FROM events) q"""


@plan("timestamp_parse", "P24", f"""
WITH c AS ({CLOCK})
SELECT event_id, stamp, CASE WHEN event_id%6 = 5 THEN NULL ELSE epoch_us(date_trunc('second', ts)) - CASE WHEN event_id%6=1 THEN 7200000000 ELSE 0 END END AS us,
  CASE WHEN event_id%6 = 5 THEN NULL ELSE strftime(date_trunc('second', ts) - CASE WHEN event_id%6=1 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END, '%a, %d %b %Y %H:%M:%S GMT') END AS http_date,
  floor(epoch_us(ts)/1000)/1000e0 AS epoch_s FROM c""")
def timestamp_parse(t: Inputs):
    c = t.spark.sql(CLOCK.replace("FROM events)", "FROM {events})"), events=t.events)
    parsed = c.withColumn("at", formats.parse_timestamp(F.col("stamp")))
    return parsed.select("event_id", "stamp", F.unix_micros("at").alias("us"), formats.format_http_date(F.col("at")).alias("http_date"),
                         formats.epoch_seconds(F.col("ts").cast("timestamp")).alias("epoch_s"))


@plan("conditional_requests", "P25", f"""
WITH {STORE},
j AS (SELECT event_id, ts, r.x, r.y, mtime, user_id FROM tile_requests r JOIN store USING (z, x, y))
SELECT event_id, CASE WHEN user_id%3 = 0 THEN 304 WHEN user_id%3 = 1 AND user_id%2 = 0 THEN 304 ELSE 200 END AS status,
  CASE WHEN user_id%5 = 0 THEN 'no-cache, no-store' ELSE 'public, max-age=3600, s-maxage=3600' END AS cache_control,
  cast(128 AS int) AS etag_length FROM j""")
def conditional_requests(t: Inputs):
    # a third of the clients resend the tag, a third a date (half of them newer), the rest nothing
    joined = t.tile_requests.join(current_store(t).select("z", "x", "y", "mtime", "size"), ["z", "x", "y"])
    tag = req.etag(F.date_format("mtime", "yyyy-MM-dd HH:mm:ss"), F.col("size"))
    user = F.col("user_id")
    rows = joined.withColumn("tag", tag).withColumn(
        "if_none_match", F.when(user % 3 == 0, F.col("tag")).when(user % 3 == 1, F.lit("")).otherwise("other")
    ).withColumn("if_modified_since", F.when(user % 3 == 1, F.when(user % 2 == 0, F.col("ts")).otherwise(
        F.lit("1990-01-01").cast("timestamp_ntz"))))
    return rows.select(
        "event_id", req.response_status(F.col("tag"), F.col("mtime"), F.col("if_none_match"), F.col("if_modified_since")).alias("status"),
        req.cache_control(user % 5 != 0, 3600).alias("cache_control"), F.length("tag").alias("etag_length"))
