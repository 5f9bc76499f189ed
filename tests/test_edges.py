"""Boxes off the grid, absent tiles, odd files and other borders of the operators."""

import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilespark.functions import coverages as texts
from tilespark.functions import geometry as geo
from tilespark.functions import requests
from tilespark.functions.tilemath import GEODETIC, MERC_LIMIT, MERCATOR, WEBMERCATOR, Grid
from tilespark.operators import cache_state, catalog, coverage as cov, raster, vector
from tilespark.sources import containers, directory
from tilespark.streaming import jobs
from tilespark.streaming import requests as stream

BOX = "box struct<minx:double,miny:double,maxx:double,maxy:double>"
SQRT2 = Grid("sqrt2", "EPSG:4326", (-180.0, -90.0, 180.0, 90.0), tuple(1.40625 / 2 ** (z / 2) for z in range(10)), origin="sw")


@pytest.mark.parametrize("box,n", [
    ((200.0, 0.0, 210.0, 10.0), 0), ((-300.0, 0.0, -250.0, 10.0), 0), ((0.0, 100.0, 10.0, 120.0), 0), ((170.0, 80.0, 250.0, 130.0), 1),
    ((-500.0, -500.0, 500.0, 500.0), 32), ((0.0, 0.0, 0.0, 0.0), 1)])
def test_boxes_off_the_grid(spark, box, n):
    rows = spark.createDataFrame([(1, box)], f"id int, {BOX}").withColumn("z", F.lit(3))
    for spread in (False, True):
        tiles = cov.affected_tiles(rows, GEODETIC, spread=spread).collect()
        assert len(tiles) == n and all(0 <= t.x < 8 and 0 <= t.y < 4 for t in tiles)
    assert cov.count_box_tiles(rows, GEODETIC).first().n_tiles == n


def test_features_partly_off_the_grid(spark):
    parts = "array<array<array<struct<x:double,y:double>>>>"
    feats = spark.createDataFrame([("l", 1, "LineString", [[[(-250.0, -120.0), (-170.0, -80.0)]]])], f"layer string, fid long, geom_type string, parts {parts}")
    cover = spark.createDataFrame([(7, (-300.0, -200.0, -150.0, 0.0), None)], f"coverage int, {BOX}, polygon array<array<struct<x:double,y:double>>>")
    assert [r.coverage for r in vector.features_in_coverages(feats, cover, GEODETIC).collect()] == [7]


def test_grids_that_do_not_halve(spark):
    cover = spark.createDataFrame([(1, (-180.0, -90.0, 180.0, 90.0), None)], f"coverage int, {BOX}, polygon array<array<struct<x:double,y:double>>>")
    with pytest.raises(ValueError, match="count_box_tiles"):
        cov.count_tiles(cover, SQRT2, 6)
    boxes = cover.withColumn("z", F.lit(5))
    assert cov.count_box_tiles(boxes, SQRT2).first().n_tiles == np.prod(SQRT2.size(5))


def tiles(spark, *rows):
    return spark.createDataFrame(rows, "x long, y long, vals array<double>")


def test_absent_tiles_are_nodata(spark):
    t = tiles(spark, (0, 0, [1.0, 2.0, 3.0, 4.0]))
    pts = spark.createDataFrame([(1, 1.5, 0.5), (2, 3.5, 0.5), (3, 0.5, 0.5)], "id int, px double, py double")
    got = {r.id: r.value for r in raster.sample_points(pts, t, "id", "px", "py", 2, F.lit(4), F.lit(2), -9.0).collect()}
    assert got == {1: pytest.approx(3.0), 2: 0.0, 3: pytest.approx(2.5)}


SRC = Grid("s", "EPSG:3857", (0.0, 0.0, 64.0, 64.0), (1.0,), tile_size=8)
DST = Grid("d", "EPSG:3857", (0.0, 0.0, 64.0, 64.0), (2.0,), tile_size=8)


def test_targets_with_some_or_no_source(spark):
    t = tiles(spark, *[(x, y, [float(x + y)] * 64) for x in range(3) for y in range(3)])
    targets = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (0, 3, 3), (0, 9, 9)], "z int, x long, y long")
    whole, rejected = raster.split_complete(raster.source_blocks(targets, t, DST, SRC, 0, margin=0))
    assert [(r.x, r.y) for r in whole.collect()] == [(0, 0)] and sorted((r.x, r.y) for r in rejected.collect()) == [(1, 1), (3, 3), (9, 9)]
    with pytest.raises(Exception, match="source tiles"):
        raster.source_blocks(targets, t, DST, SRC, 0, most_tiles=2).collect()


def test_null_cells_are_no_missing_tiles(spark):
    t = tiles(spark, *[(x, y, [None] * 64) for x in range(2) for y in range(2)])
    targets = spark.createDataFrame([(0, 0, 0)], "z int, x long, y long")
    assert not raster.source_blocks(targets, t, DST, SRC, 0, margin=0).first().missing


def test_box_resampling(spark):
    cells = np.arange(256.0).reshape(16, 16)
    t = tiles(spark, *[(x, y, cells[y * 8:y * 8 + 8, x * 8:x * 8 + 8].ravel().tolist()) for x in range(2) for y in range(2)])
    targets = spark.createDataFrame([(0, 0, 0)], "z int, x long, y long")
    (row,) = raster.warp(raster.source_blocks(targets, t, DST, SRC, 0), DST, SRC, 0, method="box").collect()
    want = cells.reshape(8, 2, 8, 2).mean((1, 3))
    assert np.allclose(np.array(row.vals).reshape(8, 8), want)


@pytest.mark.parametrize("method", ["nearest", "bilinear", "box"])
def test_warp_of_targets_off_the_source(spark, method):
    t = tiles(spark, *[(x, y, [7.0] * 64) for x in range(8) for y in range(8)])
    targets = spark.createDataFrame([(0, 1, 1), (0, 9, 9), (0, -3, 1), (0, 1, 40)], "z int, x long, y long")
    got = {(r.x, r.y): r.vals for r in raster.warp(raster.source_blocks(targets, t, DST, SRC, 0), DST, SRC, 0, method=method).collect()}
    assert got == {(1, 1): [7.0] * 64, **{k: [None] * 64 for k in ((9, 9), (-3, 1), (1, 40))}}


def test_a_slot_held_twice(spark):
    t = tiles(spark, (0, 0, [1.0]), (0, 0, [1.0]), (1, 0, [2.0])).withColumn("g", F.lit(1))
    assert raster.mosaic(t, ["g"], F.col("x"), 2, 1, 1, 1).first().vals == [1.0, 2.0]


def test_large_rasters_in_bounded_time(spark):
    import time

    r = np.random.default_rng(0)
    rows = [(x, y, r.normal(size=256 * 256).tolist()) for x in range(4) for y in range(4)]
    base = tiles(spark, *rows).withColumn("z", F.lit(4)).cache()
    base.count()
    began = time.time()
    up = {(p.z, p.x, p.y): p.vals for p in raster.pyramid(base, 2, 256).filter("z = 2").collect()}
    assert time.time() - began < 20 and len(up) == 1
    whole = np.block([[np.array(rows[x * 4 + y][2]).reshape(256, 256) for x in range(4)] for y in range(4)])
    assert np.allclose(np.array(up[2, 0, 0]).reshape(256, 256), whole.reshape(256, 4, 256, 4).mean((1, 3)))


def test_two_levels_as_near(spark):
    wanted = spark.createDataFrame([(5, 8, 8)], "z int, x long, y long")
    held = spark.createDataFrame([(6, 16, 16), (4, 4, 4)], "z int, x long, y long")
    assert [tuple(r) for r in cache_state.nearest_levels(wanted, held, up=1, down=1).select("src_z", "n_src").collect()] == [(4, 1)]


def test_the_poles_have_a_place(spark):
    box = spark.range(1).select(geo.reproject_bbox(geo.bbox(-180, -90, 180, 90), "EPSG:4326", "EPSG:3857").alias("b")).first().b
    assert box.miny < -MERC_LIMIT and box.maxy > MERC_LIMIT


def test_limits_of_queries_are_told(spark):
    params = requests.query_params(F.lit("a=" + "x" * 1200 + "&" + "n" * 120 + "=1&b=2"))
    row = spark.range(1).select(
        requests.canonical_query(params).alias("whole"), requests.canonical_query(params, 100, 1000).alias("cut"),
        requests.query_truncated(params, 100, 1000).alias("told"), requests.query_truncated(params, 200, 2000).alias("fine")).first()
    assert "x" * 1200 in row.whole and "N" * 120 in row.whole and row.told and not row.fine
    assert "x" * 1001 not in row.cut and "N" * 101 not in row.cut and "B=2" in row.cut


def test_unknown_files_are_listed(spark, tmp_path):
    t = spark.createDataFrame([(3, 1, 2, "png", bytearray(b"p"))], "z int, x long, y long, format string, data binary")
    directory.export_files(t, str(tmp_path / "d"), "tc")
    (tmp_path / "d" / "readme.txt").write_text("hello")
    assert directory.scan_tiles(spark, str(tmp_path / "d"), "tc", "s").count() == 1
    assert [r.path.rsplit("/", 1)[1] for r in directory.unknown_files(spark, str(tmp_path / "d"), "tc").collect()] == ["readme.txt"]


TILES = [(1, 0, 0, "png", bytearray(b"a")), (1, 1, 1, "png", bytearray(b"b"))]


@pytest.mark.parametrize("grid,code", [(WEBMERCATOR, 3857), (GEODETIC, 4326)])
def test_geopackage_is_whole(spark, tmp_path, grid, code):
    t = spark.createDataFrame(TILES, "z int, x long, y long, format string, data binary")
    (made,) = containers.export_containers(t, str(tmp_path), "gpkg", "roads", grid, level=0).collect()
    con = sqlite3.connect(made.container.removeprefix("file://").removeprefix("file:"))
    assert con.execute("SELECT count(*) FROM gpkg_spatial_ref_sys WHERE srs_id IN (-1, 0, 4326, ?)", (code,)).fetchone()[0] == len({-1, 0, 4326, code})
    size, width = con.execute("SELECT pixel_x_size, matrix_width FROM gpkg_tile_matrix").fetchone()
    assert size == grid.resolutions[1] and width == 2
    assert con.execute("SELECT srs_id, min_x, max_y FROM gpkg_tile_matrix_set").fetchone() == (code, grid.bbox[0], grid.bbox[3])
    con.execute("CREATE TABLE more AS SELECT * FROM roads")
    con.execute("INSERT INTO gpkg_tile_matrix_set SELECT 'more', srs_id, min_x, min_y, max_x, max_y FROM gpkg_tile_matrix_set")
    con.commit()
    con.close()
    for path, n in ((made.container, 4), (made.container + ":more", 2)):
        assert containers.read_containers(spark, spark.createDataFrame([(path,)], "path string")).count() == n
    with pytest.raises(Exception, match="no tile table"):
        containers.read_containers(spark, spark.createDataFrame([(made.container + ":rivers",)], "path string")).count()


@pytest.mark.parametrize("grid,lat", [(GEODETIC, 0.0), (MERCATOR, 0.0)])
def test_bounds_of_other_grids(spark, grid, lat):
    t = spark.createDataFrame([("t", 2, 1, 0)], "tileset string, z int, x long, y long")
    (row,) = catalog.tileset_metadata(t, grid=grid).collect()
    want = {"GLOBAL_GEODETIC": (-90.0, -90.0, 0.0, 0.0), "GLOBAL_MERCATOR": (-90.0, -85.05112877980659, 0.0, -66.51326044311186)}[grid.name]
    assert (row.minx, row.miny, row.maxx, row.maxy) == pytest.approx(want)


def test_a_damaged_table_is_no_empty_one(spark, tmp_path):
    assert not jobs._exists(spark, str(tmp_path / "none"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("junk")
    assert jobs._exists(spark, str(tmp_path / "bad"))


def test_two_writes_of_a_stored_tile(spark):
    asked = spark.createDataFrame([(1, 2, 1, 1)], "event_id long, z int, x long, y long")
    stored = spark.sql("SELECT 2 AS z, 1L AS x, 1L AS y, timestamp'2020-01-01' AS mtime UNION ALL SELECT 2, 1L, 1L, timestamp'2024-01-01'")
    got = stream.classify(asked, stored, WEBMERCATOR, F.lit("2022-01-01").cast("timestamp")).collect()
    assert [r.state for r in got] == ["hit"]


def test_many_cornered_coverages(spark):
    import math

    def ring(n, wobble):
        return [(math.cos(a) * r, math.sin(a) * r / 2) for i in range(n) for a in [2 * math.pi * i / n] for r in [100 + wobble * math.sin(37 * a)]]

    polygon = [ring(10_000, 30.0), ring(500, 0.0)[::-1]]
    cover = spark.createDataFrame([(1, (-140.0, -70.0, 140.0, 70.0), polygon)], f"coverage int, {BOX}, polygon array<array<struct<x:double,y:double>>>")
    pts = spark.range(4000).select((F.col("id") * 137.508 % 300 - 150).alias("x"), (F.col("id") * 61.8034 % 160 - 80).alias("y"))
    got = {(r.x, r.y) for r in cov.points_in_coverages(pts, cover, GEODETIC, "x", "y", depth=4).collect()}
    x, y = (np.array([r[i] for r in pts.collect()]) for i in (0, 1))
    inside = np.zeros(len(x), bool)
    for points in polygon:
        p = np.array(points)
        q = np.roll(p, -1, axis=0)
        for (x0, y0), (x1, y1) in zip(p, q):
            hit = (y0 > y) != (y1 > y)
            inside[hit] ^= x[hit] < (x1 - x0) * (y[hit] - y0) / (y1 - y0) + x0
    assert got == set(zip(x[inside].tolist(), y[inside].tolist()))
    cells = cov.coverage_cells(cover, GEODETIC, 5)
    held = cells.groupBy("z", "cell_class").agg(F.max(F.size("edges")).alias("n")).collect()
    assert all(r.n is None for r in held if r.cell_class == geo.CONTAINS) and max(r.n for r in held if r.z == 5 and r.n) < 4000


SQUARE = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]


@pytest.mark.parametrize("text,rings", [
    ("POLYGON((0 0,4 0,4 4,0 0))", [SQUARE]), ("SRID=4326; polygon z ((0 0 7, 4 0 7, 4.0 4e0 7, 0 0 7))", [SQUARE]),
    ("MULTIPOLYGON (((0 0, 4 0, 4 4, 0 0)), ((0 0, 4 0, 4 4, 0 0), (1 .5, 2 .5, 2 1, 1 .5)))", [SQUARE, SQUARE, [(1.0, 0.5), (2.0, 0.5), (2.0, 1.0), (1.0, 0.5)]]),
    ("POINT(1 2)", None), ("POLYGON((0 0, 4 x, 4 4))", None), ("POLYGON EMPTY", None), (None, None), ("", None)])
def test_wkt(spark, text, rings):
    got = spark.createDataFrame([(text,)], "t string").select(texts.polygon_from_wkt(F.col("t")).alias("p")).first().p
    assert (None if got is None else [[(v.x, v.y) for v in r] for r in got]) == rings


@pytest.mark.parametrize("text,n", [
    ('{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,0]]]}', 1), ('{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[4,0],[4,4]]],[[[0,0],[4,0],[4,4]]]]}}', 2),
    ('{"type":"FeatureCollection","features":[{"geometry":{"type":"Point","coordinates":[1,2]}},{"geometry":{"type":"Polygon","coordinates":[[[0,0,9],[4,0,9],[4,4,9]]]}}]}', 1),
    ('{"type":"Point","coordinates":[1,2]}', None), ("[]", None), ("nonsense", None), (None, None)])
def test_geojson(spark, text, n):
    got = spark.createDataFrame([(text,)], "t string").select(texts.polygon_from_geojson(F.col("t")).alias("p")).first().p
    assert (None if got is None else len(got)) == n


def test_box_text_and_points(spark):
    row = spark.createDataFrame([("1, 2,3,4", "1,2,3", "a,b,c,d")], "a string, b string, c string").select(
        *[texts.box_from_text(F.col(c)).alias(c) for c in "abc"]).first()
    assert tuple(row.a) == (1, 2, 3, 4) and row.b is None and row.c is None
    outer, inner = (geo.bbox(0, 0, 10, 10), None), (geo.bbox(2, 2, 4, 4), None)
    pts = spark.createDataFrame([(1.0, 1.0), (3.0, 3.0), (20.0, 1.0)], "x double, y double")
    held = pts.select(texts.expression_holds(("difference", outer, inner), F.col("x"), F.col("y")).alias("v")).collect()
    assert [r.v for r in held] == [True, False, False]


def test_key_value_and_export_requests(spark):
    from tilespark.sources import access_log

    urls = ["/wmts?SERVICE=WMTS&Layer=roads&TileMatrixSet=g&TileMatrix=3&TileRow=2&TileCol=1&format=image/png", "/wmts?service=wmts&TileMatrix=x&TileRow=2",
            "/arcgis/rest/services/roads/MapServer/export?bbox=1,2,3,4&size=256,512&bboxSR=4326&layers=show:1", "/arcgis/rest/services/dem/ImageServer/exportImage?size=1,2&bbox=0,0,9"]
    log = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "id int, url string")
    got = {r.id: r for r in access_log.parse_access_log(log).collect()}
    assert (got[0].family, got[0].layer, got[0].layer_spec, got[0].z, got[0].x, got[0].y, got[0].reason) == ("wmts_kvp", "roads", "g", 3, 1, 2, None)
    assert got[1].reason == "bad number"
    assert got[2].family == "arcgis" and tuple(got[2].box) == (1, 2, 3, 4) and tuple(got[2].image) == (256, 512) and got[2].srs == "4326" and got[2].reason is None
    assert got[3].family == "arcgis" and tuple(got[3].box) == (0, 0, 0, 0) and tuple(got[3].image) == (1, 2)
