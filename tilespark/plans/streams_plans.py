"""Streaming jobs, run over what is available and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tilespark.functions.tilemath import GEODETIC, WEBMERCATOR, lonlat_to_tile_x, lonlat_to_tile_y
from tilespark.functions import geometry as geo
from tilespark.plans.cache_plans import STORE, current_store, expire
from tilespark.plans.inputs import Inputs
from tilespark.plans.registry import plan
from tilespark.sources.storage import scratch
from tilespark.streaming import jobs, requests as stream


def event_stream(t: Inputs):
    """The events table as a stream of tile requests; signups ask one column past the matrix."""
    events = jobs.stream_parquet(t.spark, t.sf_dir, "events.parquet")
    eid, user, four = F.col("event_id"), F.col("user_id"), F.lit(4)
    lon, lat = eid * 137.508 % 360.0 - 180.0, eid * 61.8034 % 170.0 - 85.0
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", (user % 3).alias("service"), (user % 4).alias("layer"),
        four.alias("z"), F.when(F.col("event_type") == "signup", 16).otherwise(lonlat_to_tile_x(lon, four)).alias("x"),
        lonlat_to_tile_y(lat, four).alias("y"))


def collect_stream(t: Inputs, rows, name: str):
    path, checkpoint = scratch(t.spark, name), scratch(t.spark, f"{name}-log")
    jobs.run_available(rows, path, checkpoint)
    return t.spark.read.parquet(path)


def classified_folder(t: Inputs) -> str:
    """Where the classified requests are, written by a stream."""
    # two stored tiles share a key and only even rows are stored; the coverage ends before column 12
    stored = current_store(t).withColumn("mtime", F.col("mtime").cast("timestamp")).withColumn("y", F.col("y") * 2 % 16)
    covered = current_store(t).select("z", (F.col("x") % 12).alias("x"), "y")
    path = scratch(t.spark, "classified")
    stream.classify_stream(event_stream(t), lambda: (stored, covered), WEBMERCATOR, expire().cast("timestamp"), path, scratch(t.spark, "classified-log"))
    return path


def classified(t: Inputs):
    """The classified requests as a stream of their own."""
    return jobs.stream_parquet(t.spark, classified_folder(t))


CLASSIFIED = f"""{STORE},
cov AS (SELECT DISTINCT x%12 AS x, y FROM store), half AS (SELECT x, y*2%16 AS y, max(mtime) AS mtime FROM store GROUP BY 1, 2),
c AS (SELECT event_id, r.ts, event_type, service, layer, CASE WHEN event_type='signup' THEN 'out_of_range' WHEN cov.x IS NULL THEN 'empty'
  WHEN mtime IS NULL THEN 'miss' WHEN mtime < TIMESTAMP '1998-06-01' THEN 'stale' ELSE 'hit' END AS state
  FROM tile_requests r LEFT JOIN half s ON s.x=r.x AND s.y=r.y LEFT JOIN cov ON cov.x=r.x AND cov.y=r.y)"""


@plan("request_stream_classify", "T1", f"WITH {CLASSIFIED} SELECT event_id, state FROM c")
def request_stream_classify(t: Inputs):
    return t.spark.read.parquet(classified_folder(t)).select("event_id", "state")


@plan("store_stream_classify", "T1 T4", """
WITH k AS (SELECT o_orderkey%16 AS x, o_orderkey//16%16 AS y, max(o_orderdate) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01') AS early, max(o_orderdate) AS late
  FROM orders GROUP BY 1, 2),
c AS (SELECT event_id, event_type, CASE event_id%2 WHEN 0 THEN early ELSE late END AS mtime FROM tile_requests r LEFT JOIN k USING (x, y))
SELECT event_id, CASE WHEN event_type='signup' THEN 'out_of_range' WHEN mtime IS NULL THEN 'miss' WHEN mtime < TIMESTAMP '1998-06-01' THEN 'stale' ELSE 'hit' END AS state FROM c""")
def store_stream_classify(t: Inputs):
    # the store is written by a stream too: half of the requests see its older tiles, the other half all of them
    table, path = scratch(t.spark, "store"), scratch(t.spark, "judged")
    orders = jobs.stream_parquet(t.spark, t.sf_dir, "orders.parquet")
    key = F.col("o_orderkey")
    updates = orders.select(F.col("o_orderstatus").alias("tileset"), F.lit(4).alias("z"), (key % 16).alias("x"), (F.floor(key / 16) % 16).alias("y"),
                            F.col("o_orderdate").cast("timestamp").alias("mtime"))
    for half, rows in enumerate((updates.filter("mtime < timestamp'1998-01-01'"), updates)):
        jobs.upsert_tiles(rows, table, scratch(t.spark, f"store-log-{half}"))
        asked = event_stream(t).filter(F.col("event_id") % 2 == half)
        stream.classify_stream(asked, lambda: (t.spark.read.parquet(table), None), WEBMERCATOR, expire().cast("timestamp"), f"{path}/half={half}",
                               scratch(t.spark, f"judged-log-{half}"))
    return t.spark.read.parquet(path).select("event_id", "state")


@plan("windowed_metrics", "T2", f"""
WITH {CLASSIFIED},
w AS (SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS start_us, service, layer,
  count(*) FILTER (WHERE state='hit' AND event_type<>'error') AS hits, count(*) FILTER (WHERE state<>'hit' AND event_type<>'error') AS misses,
  count(*) FILTER (WHERE event_type='error') AS errors FROM c GROUP BY 1,2,3)
SELECT * FROM w WHERE start_us + 21600000000 <= (SELECT epoch_us(max(ts)) FROM events) - 600000000""")
def windowed_metrics(t: Inputs):
    metrics = stream.windowed_metrics(classified(t), "ts", "6 hours")
    return collect_stream(t, metrics, "metrics").select(
        F.unix_micros("window_start").alias("start_us"), "service", "layer", "hits", "misses", "errors")


@plan("sliding_metrics", "T2", f"""
WITH {CLASSIFIED}, s AS (SELECT c.*, unnest(range(4)) AS k FROM c),
w AS (SELECT epoch_us(time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01')) - k*10800000000 AS start_us, service, layer,
  count(*) FILTER (WHERE state='hit' AND event_type<>'error') AS hits, count(*) FILTER (WHERE state<>'hit' AND event_type<>'error') AS misses,
  count(*) FILTER (WHERE event_type='error') AS errors FROM s GROUP BY 1,2,3)
SELECT * FROM w WHERE start_us + 43200000000 <= (SELECT epoch_us(max(ts)) FROM events) - 600000000""")
def sliding_metrics(t: Inputs):
    metrics = stream.windowed_metrics(classified(t), "ts", "12 hours", "3 hours")
    return collect_stream(t, metrics, "sliding").select(
        F.unix_micros("window_start").alias("start_us"), "service", "layer", "hits", "misses", "errors")


@plan("metrics_between_resets", "T2", f"""
WITH {CLASSIFIED},
r AS (SELECT user_id%3 AS service, ts, lag(ts) OVER (PARTITION BY user_id%3 ORDER BY ts) AS since FROM events WHERE event_id%200 = 0),
s AS (SELECT r.*, layer FROM r JOIN (SELECT DISTINCT user_id%3 AS service, user_id%4 AS layer FROM events) l USING (service)
  WHERE epoch_us(r.ts) < (SELECT epoch_ms(max(ts)) - 600000 FROM events)*1000)
SELECT s.service, s.layer, epoch_us(s.since) AS since_us, epoch_us(s.ts) AS until_us, count(*) FILTER (WHERE state='hit' AND event_type<>'error') AS hits,
  count(*) FILTER (WHERE state<>'hit' AND event_type<>'error') AS misses, count(*) FILTER (WHERE event_type='error') AS errors
FROM s LEFT JOIN c ON c.service = s.service AND c.layer = s.layer AND c.ts < s.ts AND (s.since IS NULL OR c.ts >= s.since) GROUP BY 1, 2, 3, 4""")
def metrics_between_resets(t: Inputs):
    # every 200th event also resets the counters of its service
    events = jobs.stream_parquet(t.spark, t.sf_dir, "events.parquet")
    resets = events.filter("event_id % 200 = 0").select((F.col("user_id") % 3).alias("service"), F.col("ts").cast("timestamp").alias("ts"))
    layers = t.events.select((F.col("user_id") % 3).alias("service"), (F.col("user_id") % 4).alias("layer")).distinct()
    counted = stream.counters_between_resets(classified(t), resets, layers, "ts")
    return stream.segment_totals(collect_stream(t, counted, "segments")).select(
        "service", "layer", F.unix_micros("since").alias("since_us"), F.unix_micros("until").alias("until_us"), "hits", "misses", "errors")


@plan("meta_tile_requests", "T3", """
SELECT DISTINCT z, x - x%4 AS mx, y - y%4 AS my, epoch_us(time_bucket(INTERVAL 30 SECOND, ts, TIMESTAMP '1970-01-01')) AS slot_us
FROM (SELECT z, CASE WHEN event_type='signup' THEN 16 ELSE x END AS x, y, ts FROM tile_requests)""")
def meta_tile_requests(t: Inputs):
    once = stream.meta_tile_requests(event_stream(t), "ts")
    return collect_stream(t, once, "meta-requests").select("z", "mx", "my", F.unix_micros("slot").alias("slot_us"))


@plan("incremental_upsert", "T4", """
SELECT o_orderstatus AS tileset, cast(4 AS int) AS z, o_orderkey%16 AS x, o_orderkey//16%16 AS y, max(o_orderkey) AS payload FROM orders
WHERE (o_orderdate, o_orderkey) IN (SELECT max((o_orderdate, o_orderkey)) FROM orders GROUP BY o_orderstatus, o_orderkey%16, o_orderkey//16%16) GROUP BY 1,2,3,4""")
def incremental_upsert(t: Inputs):
    # two rounds over the same table: older half of the tiles first, then everything again
    orders = jobs.stream_parquet(t.spark, t.sf_dir, "orders.parquet")
    key = F.col("o_orderkey")
    updates = orders.select(
        F.col("o_orderstatus").alias("tileset"), F.lit(4).alias("z"), (key % 16).alias("x"), (F.floor(key / 16) % 16).alias("y"),
        F.col("o_orderdate").alias("mtime"), key.alias("payload"))
    table = scratch(t.spark, "upserted")
    early = updates.filter("mtime < timestamp_ntz'1998-01-01'")
    for part, rows in (("early", early), ("all", updates)):
        jobs.upsert_tiles(rows, table, scratch(t.spark, f"upsert-{part}"), order=("mtime", "payload"))
    return t.spark.read.parquet(table).select("tileset", "z", "x", "y", "payload")


@plan("resumable_seed", "T5 J1 J3", """
WITH b AS (SELECT o_orderkey AS task, (o_orderkey*137.508e0)%320e0-170e0 AS minx, (o_orderkey*61.8034e0)%140e0-80e0 AS miny FROM orders),
g AS (SELECT task, x, y FROM b, range(64) u(x), range(32) v(y)
  WHERE x BETWEEN floor((minx+180e0)/5.625e0+1e-9) AND ceil((minx+4e0+180e0)/5.625e0-1e-9)-1
    AND y BETWEEN floor((miny+90e0)/5.625e0+1e-9) AND ceil((miny+4e0+90e0)/5.625e0-1e-9)-1),
s AS (SELECT DISTINCT o_custkey%64 AS x, o_custkey*5%32 AS y FROM orders)
SELECT task, cast(6 AS int) AS z, x, y FROM g WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.x = g.x AND s.y = g.y)""")
def resumable_seed(t: Inputs):
    # the run is started twice on one checkpoint; the second finds nothing left to do
    orders = jobs.stream_parquet(t.spark, t.sf_dir, "orders.parquet")
    key = F.col("o_orderkey")
    minx, miny = key * 137.508 % 320.0 - 170.0, key * 61.8034 % 140.0 - 80.0
    tasks = orders.select(key.alias("task"), geo.bbox(minx, miny, minx + 4, miny + 4).alias("box"), F.lit(6).alias("z"))
    stored = t.orders.select(F.lit(6).alias("z"), (F.col("o_custkey") % 64).alias("x"), (F.col("o_custkey") * 5 % 32).alias("y")).distinct()
    path, checkpoint = scratch(t.spark, "seeded"), scratch(t.spark, "seed-log")
    for _ in range(2):
        jobs.seed(tasks, stored, GEODETIC, path, checkpoint)
    return t.spark.read.parquet(path).select("task", "z", "x", "y")
