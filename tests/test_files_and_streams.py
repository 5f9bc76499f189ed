"""Tile files, containers and streams in temporary folders."""

import datetime as dt
import sqlite3

import pytest
from pyspark.sql import functions as F

from tilespark.functions.tilemath import GEODETIC, MERCATOR, WEBMERCATOR, Grid
from tilespark.sources import containers, decode, directory
from tilespark.sources.storage import get_bytes, put_bytes
from tilespark.streaming import jobs, requests as stream


@pytest.fixture(scope="module")
def tiles(spark):
    return spark.range(200).select(
        F.lit("t").alias("tileset"), F.lit(7).alias("z"), (F.col("id") % 100).alias("x"), (F.col("id") % 90).alias("y"),
        F.lit("pbf").alias("format"), F.encode(F.concat(F.lit("payload"), F.col("id").cast("string")), "UTF-8").alias("data"))


@pytest.mark.parametrize("layout", ["tc", "mp", "tms", "reverse_tms", "quadkey", "arcgis"])
def test_directory_round_trip(spark, tiles, tmp_path, layout):
    assert directory.export_files(tiles, str(tmp_path), layout) == 200
    (tmp_path / "notes.txt.bak").write_text("x")
    back = directory.scan_tiles(spark, str(tmp_path), layout, "t")
    cols = ["z", "x", "y", "format", "data"]
    assert back.select(cols).exceptAll(tiles.select(cols)).count() == 0 and back.count() == 200
    meta = directory.scan_metadata(spark, str(tmp_path), layout, "t")
    assert "content" not in meta._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]


@pytest.mark.parametrize("kind", ["zip", "tar", "mbtiles", "gpkg"])
def test_container_round_trip(spark, tiles, tmp_path, kind):
    manifest = containers.export_containers(tiles, str(tmp_path), kind, "demo", WEBMERCATOR, level=1, max_tiles=40)
    rows = manifest.collect()
    assert len(rows) > 2 and sum(r.tiles for r in rows) == 200
    back = containers.read_containers(spark, manifest.select(F.col("container").alias("path")))
    cols = ["z", "x", "y", "data"]
    assert back.select(cols).exceptAll(tiles.select(cols)).count() == 0 and back.count() == 200
    pieces = containers.read_containers(spark, manifest.select(F.col("container").alias("path")), chunk=7)
    assert pieces.select(cols).exceptAll(tiles.select(cols)).count() == 0 and pieces.count() == 200


def test_export_to_another_grid(spark, tiles, tmp_path):
    square = tiles.filter("y < 50")
    manifest = containers.export_containers(square, str(tmp_path), "zip", "demo", MERCATOR, source=WEBMERCATOR)
    back = containers.read_containers(spark, manifest.select(F.col("container").alias("path")))
    flipped = square.select("z", "x", (127 - F.col("y")).alias("y"), "data")
    assert back.select("z", "x", "y", "data").exceptAll(flipped).count() == 0 and back.count() == square.count()
    half = WEBMERCATOR.resolutions[7] * 128
    west, south, east, north = WEBMERCATOR.bbox
    shifted = Grid("shifted", "EPSG:3857", (west + half, south, east + half, north), WEBMERCATOR.resolutions)
    with pytest.raises(ValueError):
        containers.export_containers(square, str(tmp_path), "zip", "demo", shifted, source=WEBMERCATOR)


def test_container_kinds():
    kinds = {"a.zip": "zip", "a.tar.gz": "tar", "b.mbtiles": "mbtiles", "c.gpkg": "gpkg", "c.gpkg:table": "gpkg"}
    assert {k: containers.container_kind(k) for k in kinds} == kinds
    with pytest.raises(ValueError):
        containers.container_kind("a.rar")


def test_raw_payloads_in_foreign_mbtiles(spark, tmp_path):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE TABLE metadata (name text, value text)")
    con.execute("CREATE TABLE tiles (zoom_level integer, tile_column integer, tile_row integer, tile_data blob)")
    con.execute("INSERT INTO metadata VALUES ('format', 'png')")
    con.execute("INSERT INTO tiles VALUES (2, 1, 3, ?)", (b"raw",))
    con.commit()
    put_bytes(str(tmp_path / "f.mbtiles"), con.serialize())
    row = containers.read_containers(spark, spark.createDataFrame([(str(tmp_path / "f.mbtiles"),)], "path string")).first()
    assert (row.z, row.x, row.y, row.format, bytes(row.data)) == (2, 1, 0, "png", b"raw")


def test_put_replaces_whole_files(tmp_path):
    target = str(tmp_path / "a" / "b.bin")
    for payload in (b"first", b"second"):
        put_bytes(target, payload)
    assert get_bytes(target) == b"second" and [p.name for p in (tmp_path / "a").iterdir()] == ["b.bin"]


def test_custom_decoder(tiles):
    def decoder(batch):
        return batch.assign(length=batch["data"].map(len))[["x", "length"]]

    assert decode.decode_payloads(tiles.select("x", "data"), decoder, "x long, length long").agg(F.max("length")).first()[0] == 10


def test_table_is_partitioned(spark, tiles, tmp_path):
    directory.write_table(tiles, str(tmp_path / "table"))
    plan = spark.read.parquet(str(tmp_path / "table")).filter("z = 7 AND tileset = 't'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan


def test_shards_are_bounded_by_tiles_and_bytes(spark):
    rows = spark.range(400).select(F.lit(8).alias("z"), (F.col("id") % 20).alias("x"), F.floor(F.col("id") / 20).alias("y"),
                                   F.expr("cast(repeat('x', if(id < 100, 1000, 10)) as binary)").alias("data"))
    by_tiles = containers.assign_shards(rows, 2, 50).groupBy("shard").count()
    by_bytes = containers.assign_shards(rows, 2, 1000, 20_000).groupBy("shard").agg(F.sum(F.octet_length("data")).alias("n"), F.count(F.lit(1)).alias("count"))
    assert by_tiles.count() == 8 and by_tiles.agg(F.max("count")).first()[0] < 100
    assert by_bytes.count() == 6 and by_bytes.agg(F.max("n")).first()[0] < 40_000 and by_bytes.agg(F.sum("count")).first()[0] == 400


def test_entity_tags(spark):
    import hashlib

    from tilespark.functions import requests as req

    got = spark.range(3).select("id", req.etag(F.lit("t1"), F.col("id") * 7).alias("tag")).collect()
    assert [r.tag for r in got] == [hashlib.sha512(f"t1{7 * r.id}".encode()).hexdigest().upper() for r in got]


REQUEST = "event_id long, ts timestamp, event_type string, service int, layer int, z int, x long, y long"


def at(second):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)


def requests(spark, folder, name, rows):
    spark.createDataFrame(rows, REQUEST).coalesce(1).write.mode("append").parquet(str(folder / name))


def test_stream_resumes_and_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    requests(spark, tmp_path, "in", [(1, at(0), "view", 0, 0, 2, 1, 1), (2, at(5), "view", 0, 0, 2, 9, 1)])
    stored = spark.createDataFrame([(2, 1, 1, at(0)), (2, 2, 2, at(0))], "z int, x long, y long, mtime timestamp")

    def run():
        rows = stream.classify(jobs.stream_parquet(spark, str(src)), stored, WEBMERCATOR, F.lit(at(0)))
        jobs.run_available(rows, str(tmp_path / "out"), str(tmp_path / "log"))
        return sorted((r.event_id, r.state) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [(1, "hit"), (2, "out_of_range")]
    requests(spark, tmp_path, "in", [(3, at(9), "view", 0, 0, 2, 0, 0)])
    assert run() == [(1, "hit"), (2, "out_of_range"), (3, "miss")]
    batch = stream.classify(spark.read.parquet(str(src)), stored, WEBMERCATOR, F.lit(at(0)))
    assert sorted((r.event_id, r.state) for r in batch.collect()) == run()


def test_meta_tiles_once_per_interval(spark, tmp_path):
    requests(spark, tmp_path, "in", [(1, at(0), "view", 0, 0, 4, 1, 1), (2, at(10), "view", 0, 0, 4, 3, 2), (3, at(40), "view", 0, 0, 4, 0, 0)])
    once = stream.meta_tile_requests(jobs.stream_parquet(spark, str(tmp_path / "in")), "ts")
    jobs.run_available(once, str(tmp_path / "out"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_upsert_keeps_other_partitions(spark, tmp_path):
    schema = "tileset string, z int, x long, y long, mtime timestamp, v int"

    def feed(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.upsert_tiles(jobs.stream_parquet(spark, str(tmp_path / "in")), str(tmp_path / "table"), str(tmp_path / "log"))
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "table")).select("tileset", "z", "x", "v").collect())

    assert feed(("a", 1, 0, 0, at(1), 1), ("b", 1, 0, 0, at(1), 2)) == [("a", 1, 0, 1), ("b", 1, 0, 2)]
    assert feed(("a", 1, 0, 0, at(5), 7), ("a", 1, 1, 0, at(5), 8)) == [("a", 1, 0, 7), ("a", 1, 1, 8), ("b", 1, 0, 2)]
    assert feed(("a", 1, 0, 0, at(2), 9)) == [("a", 1, 0, 7), ("a", 1, 1, 8), ("b", 1, 0, 2)]


def test_seeding_resumes(spark, tmp_path):
    tasks = "task long, box struct<minx:double,miny:double,maxx:double,maxy:double>, z int"
    stored = spark.createDataFrame([(1, 0, 0)], "z int, x long, y long")

    def run(*rows):
        if rows:
            spark.createDataFrame(rows, tasks).coalesce(1).write.mode("append").parquet(str(tmp_path / "tasks"))
        jobs.seed(jobs.stream_parquet(spark, str(tmp_path / "tasks")), stored, GEODETIC, str(tmp_path / "out"), str(tmp_path / "log"))
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run((1, (-180.0, -90.0, 180.0, 90.0), 1)) == [(1, 1, 1, 0)]
    assert run() == [(1, 1, 1, 0)]
    assert run((2, (0.0, 0.0, 10.0, 10.0), 1)) == [(1, 1, 1, 0), (2, 1, 1, 0)]


def test_classification_sees_the_store_as_it_is(spark, tmp_path):
    """A store written between batches, partitioned by block; a batch that fails half-way runs again and replaces its folder."""
    stores = "tileset string, z int, x long, y long, mtime timestamp, v int"

    def store(*rows):
        spark.createDataFrame(rows, stores).coalesce(1).write.mode("append").parquet(str(tmp_path / "writes"))
        jobs.upsert_tiles(jobs.stream_parquet(spark, str(tmp_path / "writes")), str(tmp_path / "table"), str(tmp_path / "write-log"))

    fails = [False]

    def lookup():
        if fails[0]:
            fails[0] = False
            raise RuntimeError("lost")
        return spark.read.parquet(str(tmp_path / "table")), covered

    covered = spark.createDataFrame([(9, x, 5) for x in range(0, 500)] * 2, "z int, x long, y long")

    def run():
        stream.classify_stream(jobs.stream_parquet(spark, str(tmp_path / "in")), lookup, WEBMERCATOR, F.lit(at(10)), str(tmp_path / "out"), str(tmp_path / "log"))

    def found():
        return sorted((r.event_id, r.state) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    store(("a", 9, 100, 5, at(3), 1), ("a", 9, 400, 5, at(20), 1), ("b", 9, 400, 5, at(1), 1))
    hot = [(i, at(1), "view", 0, 0, 9, 400, 5) for i in range(100, 400)]
    requests(spark, tmp_path, "in", [(1, at(0), "view", 0, 0, 9, 100, 5), (2, at(0), "view", 0, 0, 9, 101, 5), (3, at(0), "view", 0, 0, 9, 100, 6),
                                     (4, at(0), "view", 0, 0, 9, 600, 5), (5, at(0), "view", 0, 0, 9, None, 5), *hot])
    run()
    first = [(1, "stale"), (2, "miss"), (3, "empty"), (4, "out_of_range"), (5, "empty"), *((h[0], "hit") for h in hot)]
    got = found()
    assert [g for g in got if g[0] != 5] == [f for f in first if f[0] != 5]
    store(("a", 9, 101, 5, at(30), 2))
    requests(spark, tmp_path, "in", [(6, at(0), "view", 0, 0, 9, 101, 5)])
    fails[0] = True
    with pytest.raises(Exception, match="lost"):
        run()
    assert found() == got
    run()
    assert found() == sorted([*got, (6, "hit")])
    static = stream.judged(spark.read.parquet(str(tmp_path / "in")), spark.read.parquet(str(tmp_path / "table")), WEBMERCATOR, F.lit(at(10)), covered)
    assert {r.event_id: r.state for r in static.collect()}[6] == "hit" and static.count() == len(got) + 1


def test_counters_between_resets(spark, tmp_path):
    """Rows out of order over several files, a reset and events at one time, repeated resets, a layer without events."""
    import random

    r = random.Random(4)
    events = [(i, at(r.randrange(0, 4000)), r.choice(["view", "view", "error"]), 0, r.choice([0, 0, 1]), r.choice(["hit", "miss"])) for i in range(600)]
    events += [(1000 + i, at(1500), "view", 0, 0, "hit") for i in range(5)] + [(2000, at(9000), "view", 0, 0, "hit")]
    resets = [(0, at(s)) for s in (500, 1500, 1500, 3900, 20_000)] + [(1, at(100))]
    layers = spark.createDataFrame([(0, 0), (0, 1), (0, 7), (1, 0)], "service long, layer long")
    early, late = [e for e in events if e[1] < at(2000)], [e for e in events if e[1] >= at(2000)]
    r.shuffle(early)
    for n, part in enumerate((early[::2], early[1::2], late)):
        spark.createDataFrame(part, "event_id long, ts timestamp, event_type string, service long, layer long, state string").coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
        now = resets[:3] + resets[5:] if n == 0 else resets[3:5] if n == 2 else []
        if now:
            spark.createDataFrame(now, "service long, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "resets"))
        # restarted for each part; the delay covers the whole disorder
        counted = stream.counters_between_resets(jobs.stream_parquet(spark, str(tmp_path / "in")), jobs.stream_parquet(spark, str(tmp_path / "resets")), layers,
                                                 "ts", watermark="40 minutes", salts=3)
        jobs.run_available(counted, str(tmp_path / "out"), str(tmp_path / "log"))
    got = {(x.service, x.layer, x.since, x.until): (x.hits, x.misses, x.errors) for x in stream.segment_totals(spark.read.parquet(str(tmp_path / "out"))).collect()}
    want = {}
    for service, layer in ((0, 0), (0, 1), (0, 7), (1, 0)):
        marks = sorted(t for s, t in resets if s == service and t < at(20_000 - 2400))
        for since, until in zip([None, *marks], marks):
            mine = [e for e in events if e[3] == service and e[4] == layer and e[1] < until and (since is None or e[1] >= since)]
            bad = [e for e in mine if e[2] == "error"]
            n = (sum(e[5] == "hit" for e in mine) - sum(e[5] == "hit" for e in bad), sum(e[5] == "miss" for e in mine) - sum(e[5] == "miss" for e in bad), len(bad))
            want[service, layer, since, until] = tuple(map(sum, zip(n, want.get((service, layer, since, until), (0, 0, 0)))))
    assert got == want
