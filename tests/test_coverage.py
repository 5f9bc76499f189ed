"""Coverage joins and tile counts on known shapes."""

import pytest
from pyspark.sql import functions as F

from tilespark.functions import geometry as geo
from tilespark.functions.tilemath import GEODETIC
from tilespark.operators import coverage as cov

RINGS = "array<array<struct<x:double,y:double>>>"


def coverages(spark, *rows):
    return spark.createDataFrame(
        rows, f"coverage int, box struct<minx:double,miny:double,maxx:double,maxy:double>, polygon {RINGS}")


@pytest.mark.parametrize("box,levels,distinct", [
    ((-180.0, -90.0, 180.0, 90.0), (0, 1, 2), 11), ((-45.0, 0.0, 180.0, 90.0), (0, 1, 2), 6), ((-45.0, 0.0, 180.0, 90.0), (0, 2), 4),
])
def test_walk_counts(spark, box, levels, distinct):
    rows = coverages(spark, (1, box, None)).withColumn("z", F.explode(F.array(*[F.lit(z) for z in levels])))
    for spread in (False, True):
        tiles = cov.affected_tiles(rows, GEODETIC, spread=spread).select("z", "x", "y")
        assert tiles.count() == tiles.distinct().count() == distinct
    assert cov.count_box_tiles(rows, GEODETIC).agg(F.sum("n_tiles")).first()[0] == distinct


SEED = [[(10.0, 10.0), (10.0, 50.0), (-10.0, 60.0), (10.0, 80.0), (80.0, 80.0), (80.0, 10.0)]]


def test_counts_agree_with_enumeration(spark):
    polygon = coverages(spark, (1, (-10.0, 10.0, 80.0, 80.0), SEED), (2, (-180.0, -90.0, 180.0, 90.0), None))
    counted = {(r.coverage, r.z): r.tiles for r in cov.count_tiles(polygon, GEODETIC, 9, stride=3).collect()}
    levelled = polygon.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumn("edges", geo.polygon_edges(F.col("polygon")))
    tiles = cov.affected_tiles(levelled, GEODETIC).withColumn("tile", cov.tile_box(GEODETIC))
    state = F.when(F.col("edges").isNull(), geo.CONTAINS).otherwise(geo.classify_in_edges(F.col("edges"), F.col("tile")))
    brute = {(r.coverage, r.z): r.n for r in tiles.filter(state != geo.NONE).groupBy("coverage", "z").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    assert counted == brute


def test_polygon_with_hole(spark):
    outer, hole = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0)]
    df = spark.createDataFrame([([outer, hole],)], f"p {RINGS}").withColumn("e", geo.polygon_edges(F.col("p")))

    def ask(x, y):
        return df.select(geo.point_in_edges(F.col("e"), F.lit(x), F.lit(y)).alias("v")).first().v

    assert ask(1.0, 1.0) and not ask(5.0, 5.0) and not ask(11.0, 5.0)

    def state(*box):
        return df.select(geo.classify_in_edges(F.col("e"), geo.bbox(*box)).alias("v")).first().v

    assert state(1, 1, 3, 3) == geo.CONTAINS
    assert state(4.5, 4.5, 5.5, 5.5) == geo.NONE
    assert state(3, 3, 5, 5) == geo.INTERSECTS
    assert state(10, 0, 12, 2) == geo.NONE
    assert state(-5, -5, 20, 20) == geo.INTERSECTS


def test_join_equals_brute_force_and_ignores_salts(spark):
    shapes = coverages(spark, (1, (-10.0, 10.0, 80.0, 80.0), SEED), (2, (-30.0, -30.0, 33.0, 31.0), None))
    world = spark.createDataFrame([(z,) for z in (0, 2, 6, 7)], "z int").withColumn("box", geo.bbox(-60, -60, 90, 90))
    tiles = cov.affected_tiles(world, GEODETIC).select("z", "x", "y")
    pairs = tiles.crossJoin(shapes).withColumn("e", geo.polygon_edges(F.col("polygon"))).withColumn("tile", cov.tile_box(GEODETIC))
    state = F.when(F.col("e").isNull(), geo.bbox_relation(F.col("box"), F.col("tile"))).otherwise(geo.classify_in_edges(F.col("e"), F.col("tile")))
    want = {tuple(r) for r in pairs.select("z", "x", "y", "coverage", state.alias("s")).filter("s <> 'NONE'").collect()}
    for depth, salts in ((3, 1), (5, 4)):
        got = [tuple(r) for r in cov.join_coverages(tiles, shapes, GEODETIC, depth=depth, salts=salts).select(
            "z", "x", "y", "coverage", "coverage_class").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_set_algebra(spark):
    rows = [(1, 0, 4, 1, 1), (1, 0, 4, 2, 2), (1, 1, 4, 2, 2), (1, 1, 4, 3, 3), (1, 1, 4, 3, 3)]
    parts = spark.createDataFrame(rows, "id int, part int, z int, x long, y long").withColumn("n_parts", F.lit(2))

    def xs(op):
        return sorted(r.x for r in cov.combine_tile_sets(parts, ["id"], op).collect())

    assert xs("union") == [1, 2, 3] and xs("intersection") == [2] and xs("difference") == [1]


def test_compact_drops_nested_tiles(spark):
    tiles = spark.createDataFrame([(2, 1, 1), (4, 5, 6), (4, 9, 9), (3, 2, 3), (3, 2, 3)], "z int, x long, y long")
    assert sorted(tuple(r) for r in cov.compact_tiles(tiles).collect()) == [(2, 1, 1), (4, 9, 9)]


def test_other_projections_are_refused():
    with pytest.raises(ValueError):
        geo.reproject_xy(None, None, "EPSG:4326", "EPSG:25832")
