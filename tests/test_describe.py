"""Statistics, availability, layer catalogues and aligned grids on small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tilespark.operators import catalog, describe, grids
from tilespark.operators.ordering import runs


def test_statistics_document(spark):
    rows = [("a", "roads", 1, "LineString", {"lanes": "2", "na\"me": "x"}), ("a", "roads", 2, "LineString", {"lanes": "10"}), ("a", "poi", 3, "Point", {}),
            ("b", "poi", 4, "Point", {"k": "é"}), ("b", "poi", 5, "Point", {"k": "f"}), ("b", "poi", 6, "Point", {"k": "é"})]
    f = spark.createDataFrame(rows, "ts string, layer string, fid long, geom_type string, props map<string,string>")
    got = {r.tilesetid: json.loads(r.tilestats) for r in describe.statistics_documents(f, "ts").collect()}
    assert got["a"]["layerCount"] == 2 and [x["layer"] for x in got["a"]["layers"]] == ["poi", "roads"] and "attributes" not in got["a"]["layers"][0]
    roads = got["a"]["layers"][1]
    assert roads["count"] == 2 and roads["geometry"] == "LineString"
    assert roads["attributes"] == [{"attribute": "lanes", "type": "Number", "values": [10, 2], "min": 2.0, "max": 10.0},
                                   {"attribute": 'na"me', "type": "String", "values": ["x"]}]
    assert got["b"]["layers"][0]["attributes"][0]["values"] == ["é", "f"]
    few = {r.tilesetid: json.loads(r.tilestats) for r in describe.statistics_documents(f, "ts", most_values=1).collect()}
    assert few["b"]["layers"][0]["attributes"][0]["values"] == ["é"]


@pytest.mark.parametrize("buckets", [1, 7, 8192])
def test_frequent_values_against_counts(spark, buckets):
    """Attributes with few values, with many and some frequent ones, and without any; any number of buckets gives the same."""
    from collections import Counter

    r = random.Random(3)
    rows = [("few", str(r.randrange(9))) for _ in range(300)] + [("rare", str(i)) for i in range(400)] + [("none", None)] * 5 + [(None, "x")] * 3
    rows += [("wide", r.choice(["a", "b", f"v{r.randrange(3000)}"])) for _ in range(3000)]
    got = describe.frequent_values(spark.createDataFrame(rows, "k string, v string"), ["k"], "v", most=10, share=50, buckets=buckets).collect()
    want = set()
    for k in {a for a, _ in rows}:
        n = Counter(v for a, v in rows if a == k and v is not None)
        total = sum(n.values())
        kept = sorted(n.items(), key=lambda x: (-x[1], x[0]))
        want |= {(k, v, c) for v, c in [x for x in kept if len(n) <= 10 or x[1] * 50 >= total][:10]}
    assert {(x.k, x.value, x["count"]) for x in got} == want and len(got) == len(want)


def test_runs_over_block_borders(spark):
    r = random.Random(1)
    held = {"full": list(range(0, 3000)), "edge": [1022, 1023, 1024, 2047, 2048, 5000], "gap": [x for x in range(4000) if x % 1024 != 500], "some": r.sample(range(6000), 3000)}
    rows = [(k, v) for k, vs in held.items() for v in vs] + [("edge", 1023)]
    got = sorted((x.k, x.first, x.last) for x in runs(spark.createDataFrame(rows, "k string, v long"), ["k"], "v", block=64).collect())
    want = []
    for k, vs in held.items():
        vs = sorted(vs)
        starts = [v for v in vs if v - 1 not in set(vs)] if len(vs) < 100 else [v for i, v in enumerate(vs) if i == 0 or vs[i - 1] != v - 1]
        ends = [v for i, v in enumerate(vs) if i == len(vs) - 1 or vs[i + 1] != v + 1]
        want += [(k, a, b) for a, b in zip(starts, ends)]
    assert got == sorted(want)


def test_a_full_level_is_one_rectangle(spark):
    tiles = spark.range(128 * 128).select(F.lit("t").alias("tileset"), F.lit(7).alias("z"), (F.col("id") % 128).alias("x"), F.floor(F.col("id") / 128).alias("y"))
    (row,) = catalog.availability(tiles, block=16).collect()
    assert (row.start_x, row.end_x, row.start_y, row.end_y) == (0, 127, 0, 127)
    holes = tiles.filter("not (x = 40 and y between 10 and 20)")
    found = catalog.availability(holes, block=16).collect()
    assert sum((r.end_x - r.start_x + 1) * (r.end_y - r.start_y + 1) for r in found) == holes.count() and len(found) == 4


@pytest.mark.parametrize("piece", [1, 2, 1000])
def test_layer_description_in_pieces(spark, piece):
    rows = [("d", 0, 0, 0), ("d", 2, 1, 1), ("d", 2, 2, 1), ("d", 2, 0, 3), ("d", 3, 7, 7), ("d", 3, 1, 0), ("d", 3, 5, 0), ("e\"x", 1, 0, 0)]
    t = spark.createDataFrame(rows, "tileset string, z int, x long, y long")
    found = describe.layer_pieces(t, "{z}/{x}/{y}.terrain?v={version}", piece=piece).collect()
    text = {}
    for r in sorted(found, key=lambda r: (r.tileset, r.z, r.piece)):
        text[r.tileset] = text.get(r.tileset, "") + r.text
    doc = json.loads(text["d"])
    box = lambda a, b, c, d: {"startX": a, "startY": b, "endX": c, "endY": d}
    assert doc["available"] == [[box(0, 0, 0, 0)], [], [box(0, 3, 0, 3), box(1, 1, 2, 1)], [box(1, 0, 1, 0), box(5, 0, 5, 0), box(7, 7, 7, 7)]]
    assert (doc["minzoom"], doc["maxzoom"]) == (0, 3) and len(doc["bounds"]) == 4 and json.loads(text['e"x'])["available"] == [[], [box(0, 0, 0, 0)]]
    assert max(r.text.count("startX") for r in found) <= piece


def test_field_types_join_upwards(spark):
    rows = [("a", "l", 1, {"b": "true", "n": "1", "s": "x", "bn": "true", "ns": "1"}), ("a", "l", 3, {"b": "false", "n": "2.5", "bn": "1", "ns": "x", "z": None}),
            ("a", "m", 2, {}), ("b", "l", 5, {"b": "1"})]
    f = spark.createDataFrame(rows, "tileset string, layer string, z int, props map<string,string>")
    got = {(r.tileset, r.layer): (r.fields, r.minzoom, r.maxzoom) for r in describe.layer_catalogue(f).collect()}
    assert got == {("a", "l"): ({"b": "Boolean", "n": "Number", "s": "String", "bn": "String", "ns": "String", "z": "String"}, 1, 3), ("a", "m"): (None, 2, 2),
                   ("b", "l"): ({"b": "Number"}, 5, 5)}
    sets = spark.createDataFrame([("a", "http://h/", "mvt", 0.0, 0.0, 10.0, 20.0, 5, 1, "raster"), ("x", "http://h/", "png", 0.0, 0.0, 1.0, 1.0, 0, 3, None), ("y", "http://h/", "png", 0.0, 0.0, 1.0, 1.0, 0, 3, None)],
                                 "id string, url string, format string, minx double, miny double, maxx double, maxy double, minzoom int, maxzoom int, type string")
    docs = {r.id: json.loads(r.tilejson) for r in describe.tilejson_documents(sets, describe.layer_catalogue(f), satellite="y").collect()}
    assert [docs[k]["type"] for k in "axy"] == ["vector", "raster-dem", "raster"]
    assert docs["a"]["vector_layers"] == [{"id": "l", "fields": got["a", "l"][0], "minzoom": 1, "maxzoom": 3}, {"id": "m", "fields": {}, "minzoom": 2, "maxzoom": 2}]
    assert (docs["a"]["minzoom"], docs["a"]["maxzoom"], docs["a"]["center"], docs["a"]["tiles"]) == (1, 5, [5.0, 10.0, 0.0], ["http://h/a/{z}/{x}/{y}.mvt"])


OPTIONS = ("grid string, minx double, miny double, maxx double, maxy double, tile_size int, num_levels int, res_factor string, min_res double, max_res double, "
           "resolutions array<double>, align_with string")


def test_aligned_grids(spark):
    def row(name, align=None, levels=None, factor="2", lo=None, hi=None, res=None, width=1000.0):
        return (name, 0.0, 0.0, width, width, 250, levels, factor, lo, hi, res, align)

    rows = [row("base", levels=5), row("whole", "base"), row("narrow", "base", width=300.0), row("short", "base", levels=2), row("fine", "base", lo=0.7), row("dense", "base", factor="sqrt2", levels=3),
            row("loose", "dense"), row("listed", res=[9.0, 3.0, 1.0]), row("on_listed", "listed"), row("loop_a", "loop_b"), row("loop_b", "loop_a"), row("behind", "loop_a"),
            row("self", "self"), row("lost", "nowhere"), row("behind_lost", "lost"), row("empty", "base", hi=0.001), row("on_empty", "empty")]
    levels, none = grids.aligned_grid_levels(spark.createDataFrame(rows, OPTIONS))
    got = {r.grid: r.resolutions for r in levels.collect()}
    root = 2 ** 0.5
    assert got["base"] == got["whole"] == [4, 2, 1, 0.5, 0.25] and got["narrow"] == [1, 0.5, 0.25] and got["short"] == [4, 2] and got["fine"] == [4, 2, 1]
    assert got["dense"] == pytest.approx([4, 4 / root, 2, 2 / root, 1, 1 / root]) and got["loose"] == [4, 2, 1]
    assert got["listed"] == [9, 3, 1] and got["on_listed"] == [3, 1] and got["empty"] == got["on_empty"] == []
    assert {r.grid: r.reason for r in none.collect()} == {"loop_a": "circular", "loop_b": "circular", "behind": "circular", "self": "circular", "lost": "unknown", "behind_lost": "unknown"}


def test_levels_with_thresholds(spark):
    cases = [([1000.0, 500.0, 200.0], [700.0], {1500.0: 0, 1000.0: 0, 701.0: 0, 700.0: 1, 500.0: 1, 420.0: 2, 200.0: 2, 10.0: 2}),
             ([1000.0, 500.0, 200.0], None, {1500.0: 0, 900.0: 0, 700.0: 1, 500.0: 1, 435.0: 1, 430.0: 2}),
             ([1000.0, 500.0, 200.0, 100.0], [5000.0, 700.0, 120.0], {900.0: 0, 650.0: 1, 150.0: 2, 120.0: 3, 110.0: 3}),
             ([10.0, 9.5, 5.0], None, {10.0: 0, 9.7: 0, 9.5: 1, 9.0: 1, 8.0: 2})]
    for res, marks, want in cases:
        df = spark.createDataFrame([(r, res, marks) for r in want], "r double, levels array<double>, marks array<double>")
        got = {x.r: x.level for x in df.select("r", grids.level_with_thresholds(F.col("levels"), F.col("marks"), F.col("r")).alias("level")).collect()}
        assert got == want
