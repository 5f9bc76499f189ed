import zlib

import numpy as np
import pytest
from odd import documents, none, rows, words
from pyspark.sql import functions as F

from tilespark.llm import toxicity
from tilespark.llm.queries import op4_toxicity


@pytest.fixture(scope="module")
def model(spark):
    r = np.random.default_rng(0)
    docs, labels = [], []
    for d in range(600):
        w = words(int(r.integers(5, 60)), d).split()
        if d % 3 == 0:
            w[int(r.integers(len(w)))] = ["vile", "vilest", "nasty!"][d // 3 % 3]
        docs.append((d, " ".join(w), ["en", "fr"][d % 2]))
        labels.append((d, int(d % 3 == 0)))
    labels += [(None, 1), (1000, 0), (3, None), (6, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    return marks, frame, dict((d, y) for d, y in labels[:600])


def test_held_out_accuracy(model):
    marks, frame, truth = model
    got = [r for r in toxicity.classify(frame, marks).withColumn("out", toxicity.held_out(F.col("doc_id"))).collect() if r.out]
    assert len(got) > 100 and all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in got) / len(got) > 0.97
    assert sum(r.rejected == truth[r.doc_id] for r in got) / len(got) > 0.97


def test_driver_holds_a_word_once(model, monkeypatch):
    """The sample comes to the driver whole; words that its texts share are one object there."""
    marks, frame, _ = model
    held = []
    monkeypatch.setattr(toxicity, "_fit", lambda texts, *a, fit=toxicity._fit: (held.extend(w for t in texts for w in t), fit(texts, *a))[1])
    toxicity.fit(frame, toxicity._marks(marks, "doc_id", "toxic"), epochs=1)
    assert len(held) > 3000 and len({id(w) for w in held}) == len(set(held))


def test_query_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = op4_toxicity(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.collect())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.rejected == (r.score >= r.threshold) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    good = [r.score for r in held if not truth[r.doc_id]]
    bad = [r.score for r in held if truth[r.doc_id]]
    assert np.mean([b > g for b in bad for g in good]) > 0.6 and np.mean(np.array(good) < 0.7) > 0.85


def test_query_learns_from_enough_labels(spark):
    """The query's own accuracy on held-out rows of the larger table."""
    truth = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [r for r in op4_toxicity(spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in truth]
    bad, good = [r for r in held if truth[r.doc_id]], [r for r in held if not truth[r.doc_id]]
    assert len(bad) > 30 and np.mean([r.predicted for r in bad]) > 0.85 and np.mean([r.rejected for r in bad]) > 0.85
    assert np.mean([r.predicted for r in good]) < 0.02 and np.mean([r.rejected for r in good]) < 0.02


def test_words_alone_enter_a_score(model, spark):
    marks, docs, _ = model
    text = words(30, 7) + " vile"
    frame = spark.createDataFrame([(2001, text, "en", "a"), (2002, text, None, None), (None, text, "xx", "b")], "doc_id long, text string, lang string, source string")
    got = toxicity.classify(frame.unionByName(docs.withColumn("source", F.lit("s"))), marks).filter("doc_id is null or doc_id > 2000").collect()
    assert len(got) == 3 and len({r.score for r in got}) == 1 and {r.threshold for r in got if r.lang != "en"} == {0.7}


def test_odd_rows(model, spark):
    marks = model[0].unionByName(spark.createDataFrame([(d, int(d == 3)) for d in (1, 2, 3, 4, 5, 6, 7, 8)], "doc_id long, toxic int"))
    got = toxicity.classify(documents(spark), marks)
    assert got.columns.count("score") == 1 and "n_words" in got.columns
    found = got.collect()
    assert len(found) == len(rows()) and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if not (r.text or "").split()}) == 1
    again = toxicity.classify(documents(spark), marks).collect()
    assert sorted((str(r.doc_id), r.score) for r in found) == sorted((str(r.doc_id), r.score) for r in again)
    assert toxicity.classify(none(spark), marks).count() == 0


def test_filters_stay_inside_texts():
    r = np.random.default_rng(3)
    shape = {w: r.normal(size=(w, toxicity.WIDTH, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS}
    n = len(toxicity.WIDTHS) * toxicity.FILTERS
    m = toxicity.Model(np.zeros((2, toxicity.WIDTH), np.float32), shape, r.normal(size=n).astype(np.float32), np.ones(n, np.float32), 0.0)
    x, ends = r.normal(size=(30, toxicity.WIDTH)).astype(np.float32), np.array([0, 0, 1, 3, 3, 12, 30, 30])
    got = m.pooled(x, ends)[0]
    for d in range(len(ends) - 1):
        part = x[ends[d]:ends[d + 1]]
        for k, w in enumerate(toxicity.WIDTHS):
            b = m.bias[k * toxicity.FILTERS:(k + 1) * toxicity.FILTERS]
            values = [b + np.einsum("we,wef->f", part[i:i + w], shape[w]) for i in range(len(part) - w + 1)]
            want = np.maximum(np.max(values, axis=0), 0) if values else np.zeros(toxicity.FILTERS)
            assert np.allclose(got[d, k * toxicity.FILTERS:(k + 1) * toxicity.FILTERS], want, atol=1e-4)


def test_labels_that_teach_nothing(spark):
    docs = documents(spark)
    for labels in ([], [(1, 1)], [(i, 0) for i in range(20)]):
        assert {r.score for r in toxicity.classify(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()} == {0.5}
    kept = toxicity.without_toxic(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert kept.columns == docs.columns and kept.count() == len(rows())


def test_thresholds_count_all_labelled_rows(spark, monkeypatch):
    docs, labels = [], []
    for d in range(900):
        w, lang = words(12, d).split(), "de" if d % 15 in (0, 1) else "en"
        bad = d % 3 == 0
        if bad:
            w[d % 12] = "vile"
        docs.append((d, " ".join(w), lang))
        labels.append((d, int(bad)))
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    seen, limits = [], []
    put = toxicity.thresholds

    def watch(rows, counts):
        seen.append({r.d for r in rows.collect()})
        limits.append(put(rows, counts))
        return limits[-1]

    monkeypatch.setattr(toxicity, "thresholds", watch)
    toxicity.classify(frame, marks, per_class=60).collect()
    rest = {d for d, _ in labels if zlib.crc32(str(d).encode()) % 3 != 1}
    # 120 chosen, of which 90 are fitted on; the rare language has a threshold too
    assert len(seen) == 1 and seen[0] <= rest and len(seen[0]) == len(rest) - 90
    assert {r.lang for r in limits[0][1].collect()} == {"de", "en"}


def brute_thresholds(rows, counts):
    """The best F1 over all cuts, row by row."""
    total = [sum(y == k for _, y, _, _ in rows) for k in (0, 1)]

    def best(some, shift=0.0):
        at = sorted({round(o / toxicity.STEP) for _, _, _, o in some}, reverse=True)
        weigh = lambda y: counts[y] / total[y]
        all_bad = sum(weigh(1) for _, y, _, _ in some if y)
        scores = []
        for place in at:
            in_ = [y for _, y, _, o in some if round(o / toxicity.STEP) >= place]
            hit, miss = sum(weigh(1) for y in in_ if y), sum(weigh(0) for y in in_ if not y)
            scores.append(2 * hit / (hit + miss + all_bad))
        k = max(range(len(at)), key=lambda i: (round(scores[i], 12), -i))
        p = [1 / (1 + np.exp(-(a * toxicity.STEP + shift))) for a in at]
        return float(np.clip((p[k] + (p[k + 1] if k + 1 < len(p) else 0)) / 2, 0.2, 0.9))

    common = (min(total) * best(rows) + toxicity.PRIOR * 0.7) / (min(total) + toxicity.PRIOR)
    move = np.log(0.7 / 0.3) - np.log(common / (1 - common))
    out = {}
    for lang in {r[2] for r in rows} - {None}:
        some = [r for r in rows if r[2] == lang]
        few = min(sum(y == k for _, y, _, _ in some) for k in (0, 1))
        if few:
            out[lang] = (few * best(some, move) + toxicity.PRIOR * 0.7) / (few + toxicity.PRIOR)
    return move, out


@pytest.mark.parametrize("seed, size", [(1, 20), (2, 300), (3, 2000)])
def test_thresholds_against_brute_force(spark, seed, size):
    r = np.random.default_rng(seed)
    rows = [(d, int(y), str(r.choice(["en", "de", "xx"])) if r.random() < 0.9 else None, float(r.normal(2 * y - 1, 1.5))) for d, y in enumerate(r.random(size) < 0.3)]
    counts = {0: 3 * size, 1: size // 5 + 1}
    move, table = toxicity.thresholds(spark.createDataFrame(rows + rows[:3], "d long, _y int, lang string, odds double"), counts)
    want_move, want = brute_thresholds(rows, counts)
    assert move == pytest.approx(want_move, abs=1e-9) and {x.lang: pytest.approx(x.threshold) for x in table.collect()} == want


def test_thresholds_of_rare_languages_are_drawn_to_the_common_one(spark):
    got = {}
    for size in (1, 400):
        logit = lambda p: float(np.log(p / (1 - p)))
        rows = [(d, d % 2, "xx", logit(0.4 + 0.2 * (d % 2))) for d in range(2 * size)] + [(-d, d % 2, "en", logit(0.1 + 0.8 * (d % 2))) for d in range(2, 2000)]
        table = toxicity.thresholds(spark.createDataFrame(rows, "d long, _y int, lang string, odds double"), {0: 999 + size, 1: 999 + size})[1]
        got[size] = {r.lang: r.threshold for r in table.collect()}["xx"] - toxicity.SCORE_LIMIT
    assert abs(got[1]) < abs(got[400]) / 5 or abs(got[1]) < 0.02
