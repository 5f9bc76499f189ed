"""Tile keys, layouts, grids and level sets on known values."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilespark.functions import keys, tilemath
from tilespark.functions.tilemath import GEODETIC, WEBMERCATOR, Grid


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize("tile,bounds", [
    ((0, 0, 0), (-180.0, -85.05112877980659, 180.0, 85.05112877980659)),
    ((0, 0, 1), (-180.0, 0.0, 0.0, 85.05112877980659)),
    ((1, 1, 1), (0.0, -85.05112877980659, 180.0, 0.0)),
])
def test_tile_bounds(spark, tile, bounds):
    x, y, z = (F.lit(v) for v in tile)
    got = one(spark, b=tilemath.tile_bounds(x, y, z)).b
    assert tuple(got) == pytest.approx(bounds, abs=1e-6)


@pytest.mark.parametrize("layout,path", [
    ("tc", "12/000/003/456/000/007/089.png"), ("mp", "12/0000/3456/0000/7089.png"), ("tms", "12/3456/7089.png"),
    ("reverse_tms", "7089/3456/12.png"), ("arcgis", "L12/R00001bb1/C00000d80.png"),
])
def test_paths(spark, layout, path):
    args = (F.lit(3456), F.lit(7089), F.lit(12), F.lit("png"))
    assert one(spark, p=keys.tile_path(layout, *args)).p == path


def test_path_of_impossible_key(spark):
    assert one(spark, p=keys.tile_path("tms", F.lit(-1), F.lit(0), F.lit(1), F.lit("png"))).p is None
    assert one(spark, p=keys.tile_path("tms", F.lit(1), F.lit(0), F.lit(31), F.lit("png"))).p is None
    with pytest.raises(ValueError):
        keys.tile_path("other", F.lit(1), F.lit(1), F.lit(1), F.lit("png"))


def test_level_dirs(spark):
    row = one(spark, tc=keys.level_dir("tc", F.lit(5)), arcgis=keys.level_dir("arcgis", F.lit(5)))
    assert (row.tc, row.arcgis) == ("05", "L05")
    with pytest.raises(ValueError):
        keys.level_dir("quadkey", F.lit(5))


def test_layouts_round_trip(spark):
    tiles = spark.createDataFrame(
        [(0, 0, 0), (1, 1, 0), (9, 300, 511), (21, 2_000_123, 1_999_999), (25, 33_000_000, 12_345_678)], "z int, x long, y long")
    for layout in keys.LAYOUTS:
        path = keys.tile_path(layout, F.col("x"), F.col("y"), F.col("z"), F.lit("pbf"))
        back = tiles.withColumn("k", keys.parse_tile_path(layout, F.concat(F.lit("/root/cache/"), path)))
        wrong = back.filter((F.col("k.z") != F.col("z")) | (F.col("k.x") != F.col("x")) | (F.col("k.y") != F.col("y")) | F.col("k").isNull())
        assert wrong.count() == 0, layout


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 22), st.integers(0, 2**22), st.integers(0, 2**22)), min_size=1, max_size=30))
def test_quadkey_is_invertible(spark, tiles):
    rows = [(z, x % (1 << z), y % (1 << z)) for z, x, y in tiles]
    df = spark.createDataFrame(rows, "z int, x long, y long").withColumn("q", keys.quadkey(F.col("x"), F.col("y"), F.col("z")))
    for r in df.withColumn("bx", keys.quadkey_x(F.col("q"))).withColumn("by", keys.quadkey_y(F.col("q"))).collect():
        assert len(r.q) == r.z and (r.bx, r.by) == (r.x, r.y)


def test_level_sets(spark):
    n = F.lit(20)
    listed = F.array(*[F.lit(v) for v in (-10, 3, 1, 3, 5, 7, 50)])
    row = one(
        spark, some=tilemath.levels_from_list(listed, n), part=tilemath.levels_from_range(F.lit(1), F.lit(5), n),
        openended=tilemath.levels_from_range(F.lit(-1), F.lit(2), n), none=tilemath.levels_from_range(F.lit(6), F.lit(5), n),
        res=tilemath.levels_from_resolution_range(WEBMERCATOR, F.lit(1000.0), F.lit(100.0)))
    assert set(row.some) == {1, 3, 5, 7} and row.part == [1, 2, 3, 4, 5] and row.openended == [0, 1, 2] and row.none == []
    # 1000..100 m reach levels 8..11
    assert set(row.res) >= {8, 9, 10, 11}


def test_origin_flip_and_level_remap(spark):
    row = one(
        spark, flip=keys.to_grid_origin(F.lit(3), F.lit(16), F.lit("nw"), F.lit("sw")),
        same=keys.to_grid_origin(F.lit(3), F.lit(16), F.lit("nw"), F.lit("ul")),
        unknown=keys.to_grid_origin(F.lit(3), F.lit(16), F.lit(None).cast("string"), F.lit("sw")),
        inner=keys.internal_level(F.lit(3), F.lit(True), F.lit(True), F.lit(True)),
        negative=keys.internal_level(F.lit(-1), F.lit(True), F.lit(True), F.lit(True)),
        outer=keys.external_level(F.lit(8), F.lit(True), F.lit(True), F.lit(True)))
    assert (row.flip, row.same, row.unknown, row.inner, row.negative, row.outer) == (12, 3, 3, 8, None, 3)


def test_geodetic_sizes():
    assert [GEODETIC.size(z) for z in range(3)] == [(1, 1), (2, 1), (4, 2)]


def test_general_grid_lookup(spark):
    grid = Grid("odd", "EPSG:3857", (0.0, 0.0, 1000.0, 500.0), (10.0, 3.0, 1.0), tile_size=50)
    df = spark.range(3).select(F.col("id").cast("int").alias("z")).select(
        "z", grid.resolution(F.col("z")).alias("r"), grid.grid_w(F.col("z")).alias("w"), grid.grid_h(F.col("z")).alias("h"))
    assert [(r.r, r.w, r.h) for r in df.orderBy("z").collect()] == [(10.0, 2, 1), (3.0, 7, 4), (1.0, 20, 10)]
    assert [(r.w, r.h) for r in df.orderBy("z").collect()] == [grid.size(z) for z in range(3)]


def test_grid_options_with_listed_resolutions(spark):
    options = spark.createDataFrame([("g", 0.0, 0.0, 1024.0, 512.0, 256, None, None, None, None, [4.0, 2.0, 1.0])],
                                    "grid string, minx double, miny double, maxx double, maxy double, tile_size int, num_levels int, "
                                    "res_factor string, min_res double, max_res double, resolutions array<double>")
    got = [(r.z, r.res, r.grid_w, r.grid_h) for r in tilemath.grid_levels(options).orderBy("z").collect()]
    assert got == [(0, 4.0, 1, 1), (1, 2.0, 2, 1), (2, 1.0, 4, 2)]
