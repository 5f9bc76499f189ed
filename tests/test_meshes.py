"""Warps through a mesh, triangles of all sizes and hot keys, against direct computation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilespark.functions.tilemath import Grid
from tilespark.operators import hot, raster
from tilespark.operators.meshwarp import mesh_quads, mesh_warp

SRC = Grid("src", "local", (0.0, -64.0, 64.0, 0.0), (1.0,), tile_size=16, origin="nw")
DST = Grid("dst", "other", (-50.0, -50.0, 50.0, 50.0), (0.5,), tile_size=32, origin="nw")


def swirl():
    """Both axes depend on both, more the further out; nothing beyond a circle. A function of its own, as workers don't have this module."""
    def bent(x, y):
        r = np.hypot(x, y)
        a = 0.4 + r / 60
        with np.errstate(invalid="ignore"):
            far = np.where(r > 45, np.nan, 1.0)
        return 32 + (x * np.cos(a) - y * np.sin(a)) * far, -32 + (x * np.sin(a) + y * np.cos(a)) * far

    return bent


bent = swirl()


def smooth(c, r):
    return 100 + 3 * c - 2 * r


@pytest.fixture(scope="module")
def tiles(spark):
    rows = []
    for tx in range(4):
        for ty in range(4):
            if (tx, ty) == (3, 0):
                continue
            c, r = np.meshgrid(np.arange(16) + tx * 16, np.arange(16) + ty * 16)
            v = smooth(c, r).astype(float)
            v[c == 20] = -9999.0
            rows.append((tx, ty, v.ravel().tolist()))
    return spark.createDataFrame(rows, "x long, y long, vals array<double>")


@pytest.mark.parametrize("most_error", [2.0, 0.25])
def test_mesh_stays_within_its_bound(most_error):
    def place(c, r):
        x, y = bent(-50 + c * 0.5, 50 - r * 0.5)
        return x, -y

    boxes, sx, sy = mesh_quads(place, 200, most_error)
    seen = np.zeros((200, 200), int)
    worst = 0.0
    for (c0, r0, c1, r1), x, y in zip(boxes, sx, sy):
        seen[r0:r1, c0:c1] += 1
        c, r = np.meshgrid(np.arange(c0, c1) + 0.5, np.arange(r0, r1) + 0.5)
        u, v = (c - c0) / (c1 - c0), (r - r0) / (r1 - r0)
        px, py = place(c, r)
        for p, q in ((px, x), (py, y)):
            inside = (q[0] * (1 - u) + q[1] * u) * (1 - v) + (q[2] * (1 - u) + q[3] * u) * v
            worst = max(worst, np.nanmax(np.abs(inside - p), initial=0.0))
    c, r = np.meshgrid(np.arange(200) + 0.5, np.arange(200) + 0.5)
    assert seen.max() == 1 and seen[np.hypot(-50 + c * 0.5, 50 - r * 0.5) < 44].all() and worst <= 1.5 * most_error
    assert len(boxes) < 200 * 200 / 4


@pytest.mark.parametrize("method", ["nearest", "bilinear"])
def test_warp_against_direct_projection(spark, tiles, method):
    targets = spark.createDataFrame([(0, x, y) for x in range(7) for y in range(7)] + [(0, 900, 900)], "z int, x long, y long")
    got = {(r.x, r.y): np.array([np.nan if v is None else v for v in r.vals]).reshape(32, 32) for r in mesh_warp(
        targets, tiles, DST, SRC, 0, swirl(), method, most_error=0.05).collect()}
    compared = 0
    for (tx, ty), vals in got.items():
        c, r = np.meshgrid(np.arange(32) + 0.5, np.arange(32) + 0.5)
        x, y = bent(-50 + tx * 16 + c * 0.5, 50 - ty * 16 - r * 0.5)
        px, py = x, -y
        with np.errstate(invalid="ignore"):
            known = (px > 0.6) & (px < 63.4) & (py > 0.6) & (py < 63.4) & ~((px > 47) & (py < 17)) & (np.abs(px - 20.5) > 1.6)
        want = smooth(px - 0.5, py - 0.5)
        bound = 2.6 if method == "nearest" else 0.6
        assert np.nanmax(np.abs(vals - want)[known], initial=0.0) <= bound and not np.isnan(vals[known]).any()
        with np.errstate(invalid="ignore"):
            outside = np.isnan(px) | (px < -0.6) | (px > 64.6) | (py < -0.6) | (py > 64.6)
        assert np.isnan(vals[outside]).all()
        if method == "nearest":
            with np.errstate(invalid="ignore"):
                hole = (np.abs(px - 20.5) < 0.4) & known.any()
            assert np.isnan(vals[hole]).all()
        compared += int(known.sum())
    assert compared > 10_000 and (900, 900) not in got


def test_triangles_of_all_sizes(spark):
    r = random.Random(6)
    rows = []
    for i in range(600):
        x, y, s = r.uniform(0, 100), r.uniform(0, 100), r.choice([0.01, 0.3, 2.0, 40.0])
        rows.append(tuple(v for _ in range(3) for v in (x + r.uniform(0, s), y + r.uniform(0, s), r.uniform(0, 10))))
    rows += [(50.0, 50.0, 1.0, 50.2, 50.0, 2.0, 50.0, 50.2, 3.0)] * 300 + [(5.0, 5.0, 1.0, 5.0, 5.0, 1.0, 5.0, 5.0, 1.0)]
    names = [f"{v}{a}" for v in "abc" for a in "xyz"]
    triangles = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    points = spark.createDataFrame([(i, r.uniform(0, 100), r.uniform(0, 100)) for i in range(300)] + [(i, 50.05, 50.05) for i in range(300, 320)], "id int, px double, py double")
    want = {x.id: x.value for x in raster.mesh_sample(points, triangles, "id", "px", "py", bucket=5.0).collect()}
    for base, most in ((0.5, 1000), (0.05, 16), (500.0, 7)):
        got = {x.id: x.value for x in raster.mesh_sample_sizes(points, triangles, "id", "px", "py", base, most).collect()}
        assert got == want
    assert len(want) > 200


def test_hot_keys_are_dealt(spark):
    many = spark.createDataFrame([(7, i) for i in range(1000)] + [(i, i) for i in range(50)] + [(None, 1)], "k int, v int")
    few = spark.createDataFrame([(i, f"n{i}") for i in range(40)] + [(7, "again")], "k int, name string")
    a, b = hot.deal_hot(many, few, ["k"], ["v"], most=100)
    assert a.groupBy("k", hot.SALT).count().agg(F.max("count")).first()[0] <= 200
    for how in ("inner", "left"):
        got = sorted(map(tuple, a.join(b, ["k", hot.SALT], how).select("k", "v", "name").collect()), key=str)
        assert got == sorted(map(tuple, many.join(few, ["k"], how).select("k", "v", "name").collect()), key=str)


def test_hot_tile_samples_are_the_same(spark, tiles):
    r = random.Random(2)
    points = spark.createDataFrame([(i, r.uniform(30, 34), r.uniform(30, 34)) for i in range(400)] + [(i, r.uniform(0, 63), r.uniform(0, 63)) for i in range(400, 500)], "id int, px double, py double")
    ask = lambda most: sorted(map(tuple, raster.sample_points(points, tiles, "id", "px", "py", 16, F.lit(64), F.lit(64), -9999.0, most=most).collect()))
    assert ask(20) == ask(10**6) and len(ask(20)) == 500
