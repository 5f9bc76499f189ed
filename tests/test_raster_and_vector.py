"""Raster, stack and vector operators against plain Python."""

import json
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilespark.functions import elevation, geometry as geo
from tilespark.functions.tilemath import GEODETIC
from tilespark.operators import raster, stack, vector
from tilespark.sources import feature_json


def tiles(spark, *rows):
    return spark.createDataFrame(rows, "x long, y long, vals array<double>")


def test_mosaic_leaves_fill(spark):
    t = tiles(spark, (0, 0, [1.0, 2.0, 3.0, 4.0]), (1, 1, [5.0, 6.0, 7.0, 8.0])).withColumn("g", F.lit(1))
    m = raster.mosaic(t, ["g"], F.col("y") * 2 + F.col("x"), 2, 2, 2, 2, fill=0.0).first()
    assert m.vals == [1, 2, 0, 0, 3, 4, 0, 0, 0, 0, 5, 6, 0, 0, 7, 8] and (m.w, m.h) == (4, 4)


def test_crop_over_every_edge(spark):
    m = spark.createDataFrame([([float(i) for i in range(16)],)], "vals array<double>")

    def cut(left, top):
        return m.select(raster.crop(F.col("vals"), F.lit(4), F.lit(4), F.lit(left), F.lit(top), 2, 2, -1.0).alias("v")).first().v

    assert cut(1, 1) == [5, 6, 9, 10] and cut(-1, -1) == [-1, -1, -1, 0] and cut(3, 3) == [15, -1, -1, -1]
    assert cut(9, 9) == [-1] * 4 and cut(-5, 0) == [-1] * 4


def test_split_drops_negative_members(spark):
    m = spark.createDataFrame([([float(i) for i in range(16)], 4, 4)], "vals array<double>, w int, h int")
    members = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(0).alias("y"), F.lit(x * 2).alias("off_x"), F.lit(0).alias("off_y")) for x in (-1, 0, 1)])
    assert sorted((r.x, r.vals) for r in raster.split(m, members, 2, 2).collect()) == [(0, [0, 1, 4, 5]), (1, [2, 3, 6, 7])]


def test_pyramid_counts_nodata_out(spark):
    base = tiles(spark, (0, 0, [1.0, -9.0, -9.0, -9.0]), (1, 0, [4.0, 4.0, 6.0, 6.0])).withColumn("z", F.lit(1))
    (row,) = raster.pyramid(base, 1, 2, nodata=-9.0).collect()
    assert (row.z, row.x, row.y, row.vals) == (0, 0, 0, [1.0, 5.0, -9.0, -9.0])
    (near,) = raster.pyramid(base, 1, 2, nodata=-9.0, method="nearest").collect()
    assert near.vals[:2] == [1.0, 4.0]
    with pytest.raises(ValueError):
        raster.pyramid(base, 2, 2)


@pytest.mark.parametrize("mode,count", [("none", 100), ("unilateral", 121), ("bilateral", 144)])
def test_sample_grid_sizes(spark, mode, count):
    area = spark.createDataFrame([(mode,)], "mode string").withColumn("box", geo.bbox(0, 0, 9, 9))
    grid = raster.sample_grid(area, 10, 10, F.col("mode"))
    assert grid.count() == count
    assert grid.filter((F.col("x") != F.col("col")) | (F.col("y") != F.col("row_no"))).count() == 0


def test_borders_between_neighbours(spark):
    t = tiles(spark, (0, 0, [1.0, 2.0, 3.0, 4.0]), (1, 0, [5.0, 6.0, 7.0, 8.0]))
    b = {r.x: r for r in raster.pad(raster.exchange_borders(t, 2, 2, fill=0.0), 2, 2).collect()}
    assert b[0].vals == [0, 0, 0, 0, 0, 1, 2, 5, 0, 3, 4, 7, 0, 0, 0, 0]
    assert b[1].vals == [0, 0, 0, 0, 2, 5, 6, 0, 4, 7, 8, 0, 0, 0, 0, 0]
    u = {r.x: r for r in raster.pad(raster.exchange_borders(t, 2, 2, "unilateral", fill=0.0), 2, 2, "unilateral").collect()}
    assert u[1].vals == [0, 0, 0, 2, 5, 6, 4, 7, 8] and (u[1].w, u[1].h) == (3, 3)


def test_sampling_rules(spark):
    t = tiles(spark, (0, 0, [0.0, 10.0, 20.0, -9.0]))
    pts = spark.createDataFrame([(1, 0.5, 0.0), (2, 0.05, 0.95), (3, 0.5, 0.5), (4, 5.0, 5.0)], "id int, px double, py double")
    got = {r.id: r.value for r in raster.sample_points(pts, t, "id", "px", "py", 2, F.lit(2), F.lit(2), -9.0).collect()}
    # the void corner takes the mean of the others; positions past the edge are clamped
    assert got == {1: 5.0, 2: 0.0, 3: pytest.approx(10.0), 4: -9.0}


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(-10, 10), st.floats(-10, 10), st.floats(0, 100)), min_size=3, max_size=3),
       st.floats(-10, 10), st.floats(-10, 10))
def test_mesh_sample(spark, corners, px, py):
    (ax, ay, az), (bx, by, bz), (cx, cy, cz) = corners
    det = (by - cy) * (ax - cx) + (cx - bx) * (ay - cy)
    mesh = spark.createDataFrame([(ax, ay, az, bx, by, bz, cx, cy, cz)], ", ".join(f"{v}{c} double" for v in "abc" for c in "xyz"))
    pts = spark.createDataFrame([(1, px, py)], "id int, px double, py double")
    got = raster.mesh_sample(pts, mesh, "id", "px", "py", bucket=3.0, salts=3).collect()
    if abs(det) < 1e-6:
        return
    u = ((by - cy) * (px - cx) + (cx - bx) * (py - cy)) / det
    v = ((cy - ay) * (px - cx) + (ax - cx) * (py - cy)) / det
    if min(u, v, 1 - u - v) > 1e-6:
        assert got and math.isclose(got[0].value, u * az + v * bz + (1 - u - v) * cz, rel_tol=1e-6, abs_tol=1e-6)
    elif min(u, v, 1 - u - v) < -1e-6:
        assert not got


def test_elevation_round_trip(spark):
    df = spark.createDataFrame([(h,) for h in (-9999.9, -1.5, 0.0, 8848.8)], "h double")
    for name, (pack, unpack) in elevation.ENCODINGS.items():
        p = df.withColumn("p", pack(F.col("h"))).withColumn("back", unpack(F.col("p.r"), F.col("p.g"), F.col("p.b")))
        assert p.filter(F.abs(F.col("back") - F.col("h")) > 0.06).count() == 0, name


@pytest.mark.parametrize("base,top,alpha,want", [
    (100.0, 200.0, 0.5, 150.0), (100.0, 201.0, 0.5, 150.0), (100.0, 200.0, 0.0, 100.0), (100.0, 200.0, 1.0, 200.0),
    (100.0, 200.0, -2.0, 0.0), (100.0, 200.0, None, 200.0), (200.0, 100.0, -0.9, 255.0),
])
def test_blend(spark, base, top, alpha, want):
    df = spark.createDataFrame([(base, top, alpha)], "b double, t double, a double")
    assert df.select(stack.blend(F.col("b"), F.col("t"), F.col("a")).alias("v")).first().v == want


def test_custom_merge_function(spark):
    layers = spark.createDataFrame([(1, 1, 5.0, 1.0), (1, 2, 9.0, 1.0), (1, 3, 7.0, 1.0)], "px int, ord int, v double, a double")
    got = stack.fold_stack(layers, ["px"], ["ord"], "v", "a", merge=lambda acc, top, a: F.greatest(acc, top)).first()
    assert (got.value, got.n_layers) == (9.0, 3)


def merge_maps(base, other):
    for k, v in other.items():
        if k not in base:
            base[k] = v
        elif isinstance(base[k], dict):
            if isinstance(v, dict):
                merge_maps(base[k], v)
        elif isinstance(base[k], list):
            if isinstance(v, list):
                base[k] = base[k] + v
        else:
            base[k] = v
    return base


def flatten(node, path=()):
    for k, v in node.items():
        if isinstance(v, dict) and v:
            yield from flatten(v, (*path, k))
        else:
            yield (*path, k), v


leaf = st.one_of(st.integers(-5, 5), st.text(alphabet='ab"\\{}[', max_size=4), st.booleans(), st.none())
doc = st.recursive(st.dictionaries(st.sampled_from("abc"), st.one_of(leaf, st.lists(leaf, max_size=2)), max_size=3),
                   lambda inner: st.dictionaries(st.sampled_from("abc"), st.one_of(leaf, inner), max_size=3), max_leaves=8)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(doc, min_size=1, max_size=4))
def test_json_merge_equals_dict_merge(spark, docs):
    rows = [(1, i, json.dumps(d)) for i, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "r int, ord int, doc string")
    got = {tuple(r.path): json.loads(r.value) for r in vector.combine_json(df, ["r"], "ord", "doc").collect()}
    merged = {}
    for d in docs:
        merge_maps(merged, json.loads(json.dumps(d)))
    assert got == dict(flatten(merged))


GEOMETRIES = [
    ("Point", [1.0, 2.0]), ("MultiPoint", [[1.0, 2.0], [3.0, 4.0]]), ("LineString", [[1.0, 2.0], [3.0, 4.0]]),
    ("Polygon", [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 0.0]]]), ("MultiLineString", [[[1.0, 2.0], [3.0, 4.0]], [[5.0, 6.0], [7.0, 8.0]]]),
    ("MultiPolygon", [[[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 0.0]]]]),
]


def test_feature_json_keeps_every_geometry(spark):
    features = [{"type": "Feature", "id": i, "geometry": {"type": k, "coordinates": c}, "properties": {"n": str(i)}} for i, (k, c) in enumerate(GEOMETRIES)]
    text = json.dumps({'lay"er': {"type": "FeatureCollection", "features": features}})
    docs = spark.createDataFrame([(1, 0, 0, text), (1, 1, 0, "{}")], "z int, x long, y long, json string")
    rows = feature_json.scan_feature_tiles(docs)
    assert rows.count() == len(GEOMETRIES)
    back = feature_json.feature_tile_documents(rows).collect()
    assert len(back) == 1 and json.loads(back[0].json) == json.loads(text)
    split = feature_json.feature_tile_documents(rows, max_features=2)
    assert split.count() > 1 and feature_json.scan_feature_tiles(split).count() == len(GEOMETRIES)


def test_feature_filter_reports_pairs_once(spark):
    parts = "array<array<array<struct<x:double,y:double>>>>"
    feats = spark.createDataFrame([
        ("l", 1, "LineString", [[[(-100.0, -50.0), (100.0, 60.0)]]]), ("l", 2, "Point", [[[(5.0, 5.0)]]]),
        ("l", 3, "MultiPoint", [[[(150.0, 5.0), (170.0, 6.0)]]])], f"layer string, fid long, geom_type string, parts {parts}")
    cover = spark.createDataFrame([(7, (-90.0, -60.0, 90.0, 70.0), None)],
                                  "coverage int, box struct<minx:double,miny:double,maxx:double,maxy:double>, polygon array<array<struct<x:double,y:double>>>")
    got = sorted((r.fid, r.coverage) for r in vector.features_in_coverages(feats, cover, GEODETIC, depth=5, salts=3).collect())
    assert got == [(1, 7), (2, 7)]
