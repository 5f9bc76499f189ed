"""Near words and their forms against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from odd import SCHEMA, documents, none, rows

from tilespark.llm import spelling


def distance_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counted(docs):
    n = Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def by_hand(n):
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    near = {w: [x for k in (len(w) - 1, len(w), len(w) + 1) for x in by_length.get(k, []) if distance_one(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_query_against_brute_force(spark, sf_dir):
    from tilespark.llm.queries import op13_spelling

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = found(op13_spelling(spark, sf_dir))
    assert got == by_hand(counted(docs)) and any(r[1] for r in got)


@pytest.mark.parametrize("letters, sizes, seed", [("ab", (6, 9), 1), ("abcdef", (6, 8), 2), ("aé÷bÀz", (6, 12), 3), ("a", (6, 30), 4)])
def test_words_of_few_letters(spark, letters, sizes, seed):
    """Repeated bigrams, long chains of forms, ties."""
    r = random.Random(seed)
    n = {}
    for _ in range(500):
        w = "".join(r.choices(letters, k=r.randint(*sizes)))
        n[w] = r.choice([5, 5, 30, 200, 1000, 6000, 40_000])
        i = r.randrange(len(w))
        for v in (w[:i] + w[i + 1:], w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1:]):
            if len(v) >= 6 and r.random() < 0.5:
                n.setdefault(v, r.choice([5, 30, 200, 1000]))
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert found(spelling.variants(words)) == by_hand(n)


def test_odd_rows(spark):
    text = "colour Colour COLOUR colours colours " + "étéssée " * 6 + "x" * 40 + " a1b2 ÉTÉSSEE" * 5
    docs = [(d, t) for d, t, *_ in rows()] + [(i, text) for i in range(3)] + [(1, text), (1, text), (None, text), (9, "colour " * 100_000)]
    table = documents(spark).unionByName(spark.createDataFrame([(d, t, *[None] * 12) for d, t in docs[len(rows()):]], SCHEMA))
    want = counted(docs)
    assert dict(spelling.word_counts(table.repartition(3)).collect()) == want
    assert found(spelling.variants(spelling.word_counts(table))) == by_hand(want)


def test_pivots_are_the_cheapest_disjoint_pair():
    r = random.Random(5)
    for _ in range(500):
        places = sorted(r.sample(range(12), r.randint(3, 6)))
        costs = [r.randint(1, 9) for _ in places]
        chosen = spelling.best_pivots(places, costs)
        assert len(chosen) == 2 and abs(places[chosen[0]] - places[chosen[1]]) >= 2
        assert sum(costs[i] for i in chosen) == min(costs[i] + costs[j] for i in range(len(places)) for j in range(i) if places[i] - places[j] >= 2)
    times = {g: i for i, g in enumerate(["th", "he", "eo", "or", "ry"])}
    prefix, pivots, last = spelling.prefix_and_pivots("theory", times)
    assert (prefix, pivots, last) == ([0, 1, 2], [0, 2], (2, "eo"))


def test_one_deletion_in_many(spark):
    docs = [(d, "wonderful") for d in range(2000)]
    assert {spelling.respelt(*x) for x in docs} - {"wonderful"}
    table = spark.createDataFrame([(d, t, *[None] * 12) for d, t in docs], SCHEMA)
    got = dict(spelling.word_counts(table, least_times=1).collect())
    assert got == dict(Counter(spelling.respelt(*x) for x in docs))


def test_no_words(spark):
    assert spelling.variants(spelling.word_counts(none(spark))).count() == 0
    assert spelling.variants(spark.createDataFrame([("lonely", 7)], "word string, n long")).collect()[0].n_near == 0
