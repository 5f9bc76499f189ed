"""Cache state, routing, request parsing and fetch rules on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tilespark.functions import formats, requests as req
from tilespark.functions.tilemath import MERCATOR, WEBMERCATOR
from tilespark.operators import cache_state as cs
from tilespark.operators import fetch, ordering, routing
from tilespark.sources import access_log, manifest


def stamp(day):
    return dt.datetime(2024, 1, day)


def store(spark, *rows):
    return spark.createDataFrame(rows, "z int, x long, y long, mtime timestamp, size long")


def test_states(spark):
    stored = store(spark, (1, 0, 0, stamp(1), 5), (1, 1, 0, stamp(9), 6))
    wanted = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 1, 1)], "z int, x long, y long")
    expire = F.lit(stamp(5))
    states = {(r.x, r.y): r.state for r in cs.with_state(wanted, stored, expire).collect()}
    assert states == {(0, 0): "stale", (1, 0): "hit", (1, 1): "miss"}
    assert [(r.x, r.y) for r in cs.missing(wanted, stored).collect()] == [(1, 1)]
    assert [r.x for r in cs.stale(stored, wanted, expire).collect()] == [0]
    assert [r.x for r in cs.fresh(stored, wanted, expire).collect()] == [1]


def test_last_write_wins_with_ties(spark):
    rows = store(spark, (1, 0, 0, stamp(1), 5), (1, 0, 0, stamp(3), 7), (1, 0, 0, stamp(3), 9))
    assert [tuple(r) for r in cs.latest(rows, order=("mtime", "size")).collect()] == [(1, 0, 0, stamp(3), 9)]


def test_import_modes(spark):
    old, new = store(spark, (1, 0, 0, stamp(1), 1)), store(spark, (1, 0, 0, stamp(2), 2), (1, 1, 0, stamp(2), 3))
    assert sorted(r.size for r in cs.merge_import(old, new, True).collect()) == [2, 3]
    assert sorted(r.size for r in cs.merge_import(old, new, False).collect()) == [1, 3]


def test_cleanup_honours_age(spark):
    stored = store(spark, (1, 0, 0, stamp(1), 1), (1, 1, 0, stamp(9), 2), (1, 1, 1, stamp(1), 3))
    doomed = stored.filter("size < 3")
    assert sorted(r.size for r in cs.cleanup(stored, doomed, F.lit(stamp(5))).collect()) == [2, 3]


PATH = "array<struct<i:int,n:int>>"


@pytest.mark.parametrize("old,current,skip", [
    (None, [(0, 4)], False), ([(0, 4)], None, False), ([], [(0, 4)], True), ([(0, 4)], [(0, 4)], False),
    ([(1, 4)], [(0, 4)], True), ([(0, 4)], [(1, 4)], False), ([(0, 4), (2, 4)], [(0, 4), (1, 4)], True),
    ([(0, 4), (0, 4)], [(0, 4), (1, 4)], False), ([(0, 4)], [(0, 4), (1, 4)], False), ([(0, 4), (2, 4)], [(0, 4)], False),
    ([(2, 4)], [(0, 4), (1, 4)], True), ([(0, 4)], [], False),
])
def test_resume(spark, old, current, skip):
    df = spark.createDataFrame([(old, current)], f"o {PATH}, c {PATH}")
    assert df.select(cs.can_skip(F.col("o"), F.col("c")).alias("s")).first().s is skip


def test_rekey(spark):
    tiles = spark.createDataFrame([(4, 3, 5)], "z int, x long, y long")
    one, errors = cs.rekey(tiles, WEBMERCATOR, MERCATOR)
    assert [(r.nz, r.nx, r.ny) for r in one.collect()] == [(4, 3, 10)] and errors.count() == 0


def test_nearest_levels(spark):
    wanted = spark.createDataFrame([(3, 4, 4), (3, 0, 0), (3, 7, 7), (3, 2, 2)], "z int, x long, y long")
    held = spark.createDataFrame([(3, 4, 4), (2, 2, 2), (2, 0, 0), (1, 0, 0), (4, 14, 14), (4, 15, 15), (5, 8, 8)], "z int, x long, y long")
    got = {(r.x, r.y): (r.src_z, r.n_src) for r in cs.nearest_levels(wanted, held, up=1, down=1).collect()}
    assert got == {(4, 4): (3, 1), (0, 0): (2, 1), (7, 7): (4, 2), (2, 2): (None, 0)}


def test_filters_skip_stored_tiles(spark):
    tiles = spark.createDataFrame([(1, True), (2, False)], "v int, stored boolean")
    add = lambda df: df.withColumn("v", F.col("v") + 10)
    double = lambda df: df.withColumn("v", F.col("v") * 2)
    assert sorted(r.v for r in cs.apply_filters(tiles, [add, double]).collect()) == [1, 24]


def test_ordering_equals_window(spark):
    df = spark.range(500).select((F.col("id") % 7 == 0).cast("int").alias("k"), (F.col("id") * 37 % 101).alias("v"), "id")
    df = df.withColumn("k", F.when(F.col("k") == 1, None).otherwise(0))
    ranked = ordering.ranked_sort(df, ["k"], F.floor(F.col("v") / 5), ["v", "id"], "rn").collect()
    totals = ordering.running_total(df, ["k"], F.floor(F.col("v") / 5), ["v", "id"], F.col("v"), "sum").collect()
    for key in (None, 0):
        rows = sorted((r.v, r.id, r.rn) for r in ranked if r.k == key)
        assert [r[2] for r in rows] == list(range(1, len(rows) + 1))
        total = 0
        for v, _, got in sorted((r.v, r.id, r["sum"]) for r in totals if r.k == key):
            total += v
            assert got == total


def test_resolution_routing(spark):
    queries = [(1000.0, "low"), (2000.0, "low"), (2001.0, "low"), (0.5, "high"), (10.0, "high")]
    df = spark.createDataFrame(queries, "res double, want string")
    route = routing.route_by_resolution(F.col("res"), F.lit(10.0), F.lit("low"), F.lit("high"))
    assert df.filter(route != F.col("want")).count() == 0


def test_combining_keeps_order(spark):
    rows = [(1, 0, "a", "u", False), (1, 1, "b", "u", False), (1, 2, "c", "v", False), (1, 3, "d", "v", True), (1, 4, "e", "v", False)]
    stack = spark.createDataFrame(rows, "q int, ord int, layer string, url string, faded boolean")
    got = routing.combine_requests(stack, ["q"], ["ord"], ["url"], F.col("faded")).orderBy("request_no").collect()
    assert [r.layers for r in got] == [["a", "b"], ["c"], ["d"], ["e"]]


def test_opacity_rules(spark):
    def opaque(transparent, opacity, covers):
        cols = [F.lit(v).cast(k) for v, k in ((transparent, "boolean"), (opacity, "double"), (covers, "boolean"))]
        return spark.range(1).select(routing.is_opaque(F.lit(True), *cols).alias("o")).first().o

    assert opaque(False, None, None) and opaque(False, 0.0, True) and opaque(None, 0.99, True)
    assert not opaque(True, None, None) and not opaque(False, 0.5, True) and not opaque(False, None, False)


@pytest.mark.parametrize("url,want", [
    ("/tiles/roads/4/3/2.png", ("roads", None, 4, 3, 2, "png", None)),
    ("/tiles/1.0.0/roads/4/3/2.png", ("roads", None, 4, 3, 2, "png", None)),
    ("/tms/1.0.0/roads/EPSG900913/4/3/2.jpeg", ("roads", "EPSG900913", 4, 3, 2, "jpeg", None)),
    ("/tiles/roads/31/3/2.png", ("roads", None, 31, 3, 2, "png", "zoom too deep")),
    ("/mapbox/roads/31/3/2.mvt", ("roads", None, 31, 3, 2, "mvt", None)),
    ("/tiles/roads/4/99999999999999999999/2.png", ("roads", None, 4, None, 2, "png", "bad number")),
    ("/nothing/roads", (None, None, None, None, None, None, "no match")),
])
def test_tile_urls(spark, url, want):
    got = access_log.parse_access_log(spark.createDataFrame([(url,)], "url string")).first()
    assert (got.layer, got.layer_spec, got.z, got.x, got.y, got.format, got.reason) == want


def test_map_requests(spark):
    url = "/map?SERVICE=WMS&layers=a,b&BBOX=1,2,3,4&width=10&Height=20&crs=EPSG%3A4326&format=image/png"
    good, bad = access_log.quarantine(access_log.parse_access_log(spark.createDataFrame([(url,), ("/x",)], "url string")))
    row = good.first()
    assert (row.family, row.layer, tuple(row.box), tuple(row.image), row.srs) == ("wms", "a,b", (1.0, 2.0, 3.0, 4.0), (10, 20), "EPSG:4326")
    assert bad.count() == 1


def test_long_values_are_cut_on_request(spark):
    df = spark.createDataFrame([("a=" + "x" * 1500 + "&" + "k" * 101 + "=1&empty",)], "q string")
    params = req.query_params(F.col("q"))
    row = df.select(req.canonical_query(params).alias("whole"), req.canonical_query(params, 100, 1000).alias("cut")).first()
    assert row.whole == "A=" + "x" * 1500 + "&EMPTY=&" + "K" * 101 + "=1" and row.cut == "A=" + "x" * 1000 + "&EMPTY="


@pytest.mark.parametrize("text,want", [
    ("Sun, 06 Nov 1994 08:49:37 GMT", "1994-11-06 08:49:37"), ("Sun, 6 Nov 1994 08:49:37 GMT", "1994-11-06 08:49:37"),
    ("Sunday, 06-Nov-94 08:49:37 GMT", "1994-11-06 08:49:37"), ("Sun Nov  6 08:49:37 1994", "1994-11-06 08:49:37"),
    ("Mon, 06 Nov 23 08:49:37 GMT", "2023-11-06 08:49:37"), ("1994-11-06T08:49:37Z", "1994-11-06 08:49:37"),
    ("1994-11-06T08:49:37.5+02:00", "1994-11-06 06:49:37.5"), ("Sun, 31 Feb 1994 08:49:37 GMT", None), ("yesterday", None),
    ("Sun, 06 Xyz 1994 08:49:37 GMT", None),
])
def test_timestamps(spark, text, want):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(formats.parse_timestamp(F.col("s")).cast("string").alias("t")).first().t == want


def test_admission_order(spark):
    urls = spark.createDataFrame([(u,) for u in (
        "", "http://a.org/secret", "http://a.org/page", "http://b.org/tile", "http://c.org/tile", "http://a.org/tile")], "url string")
    hosts = lambda *h: spark.createDataFrame([(v,) for v in h], "host string")
    got = {r.url: r.reason for r in fetch.admit(urls, ["secret"], ["tile"], hosts("b.org"), hosts("a.org", "b.org")).collect()}
    assert got == {"": "missing url", "http://a.org/secret": "forbidden url", "http://a.org/page": "no filter matches",
                   "http://b.org/tile": "forbidden domain", "http://c.org/tile": "forbidden domain", "http://a.org/tile": None}


def test_template_keeps_unknown_placeholders(spark):
    tiles = spark.createDataFrame([(1, 1, 0)], "z int, x long, y long")
    url = manifest.fetch_manifest(tiles, "http://{subdomains}/{style}/{z}/{x}/{y}.{format}", WEBMERCATOR, "png").first().url
    assert url == "http://{subdomains}/{style}/1/1/0.png"
