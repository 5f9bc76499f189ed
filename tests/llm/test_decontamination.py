import hashlib
import re

from odd import documents, none, rows, words

from tilespark.llm import decontamination as dec
from tilespark.llm.queries import op9_decontamination

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = WORD.findall((t or "").encode().lower())
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k:k + 10]), set()).add(str(i))
    lengths = {len(w) for w in windows}
    for d, t in docs:
        w = WORD.findall((t or "").encode().lower())
        hit, ids = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k:k + n])):
                    hit |= set(range(k, k + n))
                    ids |= found
        yield d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = sorted(tuple(r) for r in op9_decontamination(spark, sf_dir).collect())
    assert got == sorted(brute(docs, items)) and any(r[5] for r in got)


def items_of(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_odd_rows_and_items(spark):
    items = [(10, words(80, 2)), (9, "one, TWO; three"), (9, "one two three"), (1, None), (2, ""), (3, "..."), (4, "é endoftext it"), (5, words(80, 2)[50:])]
    keys = [(r[0], r[1]) for r in rows()]
    want = sorted(brute(keys, items), key=str)
    marked = dec.mark_contaminated(documents(spark), items_of(spark, items))
    got = marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    assert marked.columns.count("n_words") == 1 and "source" in marked.columns
    kept = dec.decontaminated(documents(spark), items_of(spark, items))
    assert kept.columns == documents(spark).columns and kept.count() == sum(not w[5] for w in want)


def test_items_of_few_words_and_of_one_pattern(spark):
    """Words that repeat, items that share most of their text, items as long as a window or a run, in texts cut out of them."""
    import random

    r = random.Random(4)
    pattern = words(14, 5).split()
    items = [(i, " ".join([*pattern[:6], f"name{i % 40}", *pattern[6:], r.choice(["yes", "no"])])) for i in range(200)]
    items += [(1000 + i, " ".join(r.choices("ab", k=r.choice([1, 4, 5, 6, 9, 10, 11, 15, 23])))) for i in range(60)] + [(2000, "a " * 40)]
    docs = []
    for d in range(150):
        w = []
        for _ in range(4):
            text = r.choice(items)[1].split()
            a, b = sorted((r.randint(0, len(text)), r.randint(0, len(text))))
            w += text[a:b] + words(r.randint(0, 3), d).split() + r.choices("abc", k=r.randint(0, 12))
        docs.append((d, " ".join(w)))
    got = dec.mark_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items_of(spark, items))
    got = sorted(tuple(x) for x in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    assert got == sorted(brute(docs, items))


def test_many_items_are_one_pass(spark):
    items = [(i, words(60, 100 + i)) for i in range(5000)]  # 2 MB
    docs = [(d, words(30, 9 * d) + " " + " ".join(items[37 * d][1].split()[7:7 + d % 14]) + " " + words(5, d)) for d in range(100)]
    marked = dec.mark_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items_of(spark, items))
    assert marked._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = sorted(tuple(x) for x in marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    assert got == sorted(brute(docs, items)) and sum(x[5] for x in got) >= 20


def test_spans_are_in_the_original(spark):
    text = "Früh — Say: 'One; TWO, (three…) four' and (ONE two THREE four)!"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = dec.mark_contaminated(docs, items_of(spark, [(1, "one two three… four")])).head()
    assert [text[s.first:s.last] for s in got.spans] == ["One; TWO, (three…) four"]


def test_nothing(spark):
    assert dec.mark_contaminated(none(spark), items_of(spark, [(1, "a b")])).count() == 0
    assert dec.mark_contaminated(documents(spark), items_of(spark, [])).filter("contaminated or n_hit > 0").count() == 0
