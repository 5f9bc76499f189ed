import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from odd import documents, none, rows, words

from tilespark.llm import components, ngram_join
from tilespark.llm.queries import op7_ngram_jaccard


def grams(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(docs):
    """(doc_id, set size, smallest doc_id reachable) per row; pairs are tried one by one."""
    sets = [grams(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    held = {}
    for i, s in enumerate(sets):
        for j in {j for g in s for j in held.get(g, ())}:
            common = len(s & sets[j])
            if 100 * common >= 80 * (len(s) + len(sets[j]) - common) and find(i) != find(j):
                root[find(i)] = find(j)
        for g in s:
            held.setdefault(g, []).append(i)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in op7_ngram_jaccard(spark, sf_dir).collect()), key=str) == brute(docs)


def test_odd_rows(spark):
    got = ngram_join.classes_and_components(documents(spark)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute([(r[0], r[1]) for r in rows()])


def near_copies(seed, n=150, size=70):
    """Copies of a few bases with different numbers of edits, copies of copies, and passages that many share."""
    r = random.Random(seed)
    bases = [words(size, seed * 10 + k).split() for k in range(3)]
    passage = words(40, seed + 500).split()
    out = []
    for d in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        if r.random() < 0.3:
            w = passage + words(r.randrange(5, 60), d + 1000).split()
        if r.random() < 0.1 and out:
            w = (out[r.randrange(len(out))][1] + " tail").split()
        out.append((d, " ".join(w)))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_of_near_copies(spark, seed, monkeypatch):
    docs = near_copies(seed)
    if seed == 2:  # hot n-grams dealt to several tasks
        monkeypatch.setattr(ngram_join, "MOST", 5)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = ngram_join.classes_and_components(frame).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs)


def test_one_of_each(spark):
    kept = ngram_join.one_of_each(documents(spark))
    assert kept.columns == documents(spark).columns
    want = {}
    for d, _, c in brute([(r[0], r[1]) for r in rows()]):
        want.setdefault(d, set()).add(c)
    ids = [r.doc_id for r in kept.collect()]
    assert {i for i in ids if i is not None} == {d for d, cs in want.items() if d in cs and d is not None} and ids.count(3) == 1 and ids.count(None) == 2


def test_one_of_each_where_ids_repeat(spark):
    """Rows of one id that are near copies are one component; rows of one id that are not are two, though these share their smallest id."""
    body, other = words(80, 21), words(80, 22)
    near = body.split()
    near[30] = "changed"
    rows = [(3, body), (3, " ".join(near)), (9, body), (4, other), (4, words(60, 23)), (8, other), (5, ""), (5, None), (6, " "), (None, body), (None, body)]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    ids = sorted((r.doc_id for r in kept), key=str)
    assert ids == [3, 4, 4, 5, 6, None, None]
    assert {r.text for r in kept if r.doc_id == 4} == {other, words(60, 23)}


def test_nothing(spark):
    assert ngram_join.classes_and_components(none(spark)).count() == 0 and ngram_join.one_of_each(none(spark)).count() == 0


def test_order_puts_frequent_last():
    r = np.random.default_rng(0)
    s = np.unique(r.integers(0, 1 << 63, 500).astype(np.uint64))
    frequent = {int(s[3]): 9, int(s[10]): 5, int(s[200]): 5}
    order = ngram_join.Order(list(frequent.items()))
    whole = sorted(s.tolist(), key=lambda t: (frequent.get(t, 0), t))
    for k in (1, 5, 100, len(s)):
        assert order.first(s, k).tolist() == whole[:k]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 200), (200, 250)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {200: 200, 250: 200, 300: 200}


def test_repeated_ngrams_are_counted():
    r = np.random.default_rng(5)
    for size in (0, 1, 2, 3, 400):
        sets = [np.unique(r.integers(0, 60, size).astype(np.uint64)) for _ in range(8)]
        values, times = np.unique(np.concatenate(sets), return_counts=True)
        held = list(sets)
        got, counts = ngram_join._repeated(held)
        assert not held and dict(zip(got.tolist(), counts.tolist(), strict=True)) == {v: t for v, t in zip(values.tolist(), times.tolist(), strict=True) if t >= 3}


def test_a_large_batch_takes_little_memory():
    """One batch of 8 MB: its words and n-grams are not all held at once, and what repeats in it is found."""
    class Frame:
        def mapInArrow(self, run, schema):
            raise StopIteration(run)

    with pytest.raises(StopIteration) as found:
        ngram_join._measure(Frame(), 5)
    run = found.value.value
    body = [words(300, 100 + i) for i in range(40)]
    texts = [f"{i} {body[i % 40]} {words(60, 9000 + i)}" for i in range(3600)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text_hash": list(range(len(texts))), "text": texts})
    tracemalloc.start()
    rows = [(b.column("kind")[0].as_py(), len(b)) for b in run(iter([batch])) if len(b)]
    peak = tracemalloc.get_traced_memory()[1] / batch.column("text").nbytes
    tracemalloc.stop()
    assert sum(n for kind, n in rows if kind == 0) == len(texts) and sum(n for kind, n in rows if kind == 1) >= 40 * 290
    assert peak < 5.3
