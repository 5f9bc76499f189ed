from collections import defaultdict
from itertools import cycle

import pytest
from odd import documents, none, rows

from tilespark.llm import mixing
from tilespark.llm.queries import op1_source_mix


def targets_by_rounds(sizes, weights=(5, 2, 1), most=3):
    """Shares by weight; what is above a limit goes to the others, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = dict(zip(names, cycle(weights)))
    total, full = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        left = total - sum(full.values())
        share = {s: left * w[s] / sum(w[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return full | share
        full |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, None: 100}, {"a": 10, "b": 1000, "c": 10, "d": 5000, "e": 1}, {"a": 0, "b": 7}, {"x": 5}, {"é": 30, "z": 40, "Z": 9000, None: 1}, {"a": 0}])
def test_targets(spark, sizes):
    got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    want = targets_by_rounds(sizes)
    assert {r.source: r.target for r in got.collect()} == {s: pytest.approx(t) for s, t in want.items()}


def test_query_takes_targets(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op1_source_mix(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    size, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        n = len((docs[r.doc_id].text or "").encode().split())
        s = docs[r.doc_id].source
        assert r.size == n and r.taken % max(n, 1) == 0 and r.taken <= 3 * n
        size[s] += n
        taken[s] += r.taken
        largest[s] = max(largest[s], n)
    want = targets_by_rounds(size)
    for r in got:
        s = docs[r.doc_id].source
        assert r.source_size == size[s] and r.target == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 2 * largest[s]
    assert [tuple(r) for r in sorted(got)] == [tuple(r) for r in sorted(op1_source_mix(spark, sf_dir).collect())]


def test_odd_rows(spark):
    got = mixing.mix(documents(spark))
    assert got.columns[:2] == ["doc_id", "text"] and got.columns.count("size") == 1 and "kept" in got.columns
    found = got.collect()
    assert len(found) == len(rows())
    for r in found:
        n = len((r.text or "").encode().split())
        assert (r.size, r.taken) == (n, r.copies * n) and 0 <= r.copies <= 3
    taken = mixing.take(documents(spark))
    assert taken.columns == documents(spark).columns and taken.count() == sum(r.copies for r in found)
    assert mixing.sizes_only(documents(spark)).count() == len(rows())


def test_nothing(spark):
    assert mixing.mix(none(spark)).count() == 0 and mixing.take(none(spark)).count() == 0 and mixing.sizes_only(none(spark)).count() == 0


def test_repeated_rows_are_spread(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s")] * 900 + [(2, "c d e", "en", "t")] * 100, "doc_id long, text string, lang string, source string")
    found = mixing.sizes_only(docs).groupBy("source_size", "target").sum("taken").collect()
    for r in found:
        assert abs(r["sum(taken)"] - r.target) <= 6
