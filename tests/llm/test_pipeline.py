import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from odd import documents, none, rows, words
from test_decontamination import brute as leaks
from test_mixing import targets_by_rounds
from test_ngram_join import brute as components

from tilespark.llm import decontamination, mixing, ngram_join, toxicity
from tilespark.llm.tokens import tokenizer_path


def test_stages_on_the_given_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, tests = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect())
    scored = toxicity.classify(docs, labels)
    clean = docs.join(scored.filter("rejected").select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    single = clean.join(ngram_join.classes_and_components(clean).filter("doc_id = component_id").select("doc_id"), "doc_id", "left_semi")
    known = decontamination.mark_contaminated(single.select("doc_id", "text"), tests).filter("contaminated").select("doc_id")
    final = single.join(known, "doc_id", "left_anti").select(docs.columns)
    copies = {r.doc_id: r.copies for r in mixing.sizes_only(final).collect()}
    taken = [d for d in sorted(copies) for _ in range(copies[d])]
    assert [r[0] for r in sorted(got, key=lambda r: r[1])] == taken and len(set(taken)) < docs.count()
    start = 0
    for _, at, n, _ in sorted(got, key=lambda r: r[1]):
        assert at == start
        start += n


STAGE = dict(corpus_pipeline.STAGES)


def texts(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


@pytest.fixture(scope="module")
def awkward(spark, sf_dir):
    """Odd rows, copies of them, and passages of the given tests; more columns with clashing names."""
    item = next(r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if len(r.text.split()) >= 12)
    schema = documents(spark).schema
    more = [(50, words(40, 31) + " " + item), (51, item), (51, item), (None, item), (52, words(40, 31) + " tail"), (53, words(40, 31) + " tail")]
    extra = [(d, t, "en", "a", None, 0, "s", "w", 1, "k", 2, "d", "q", 3) for d, t in more]
    return documents(spark).unionByName(spark.createDataFrame(extra, schema)).repartition(4)


def test_toxicity_stage_on_odd_rows(spark, sf_dir, awkward):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kept = STAGE["toxicity"](spark, awkward, sf_dir)
    judged = toxicity.classify(awkward, labels)
    assert kept.columns == awkward.columns and texts(kept) == texts(judged.filter("not rejected"))
    toxic = spark.createDataFrame([(d, int(d % 2)) for d in range(100, 400)], "doc_id long, toxic int")
    more = spark.createDataFrame([(d, words(12, d) + (" vile words here" if d % 2 else ""), *["x"] * 2, None, 0, "s", "w", 1, "k", 2, "d", "q", 3) for d in range(100, 400)], awkward.schema)
    left = texts(toxicity.without_toxic(awkward.unionByName(more), toxic))
    given = texts(awkward)
    assert sum(left[k] for k in given) >= 0.8 * sum(given.values()) and all(left[k] in (0, n) for k, n in given.items()) and sum(d is not None and 100 <= d < 400 and d % 2 for d, _ in left) <= 3
    assert sum(d is not None and 100 <= d < 400 and d % 2 == 0 for d, _ in left) >= 147


def test_copies_stage_on_odd_rows(spark, sf_dir, awkward):
    given = [(r.doc_id, r.text) for r in awkward.collect()]
    got = texts(STAGE["ngram_jaccard"](spark, awkward, sf_dir))
    # of each component the smallest id, of rows with it one; rows without words or id all stay, equal ones with an id once
    smallest = {c for _, n, c in components(given) if n}
    empty = {(d, "") for d, t in given if d is not None and not (t or "").split()}
    sized = Counter(d for d, t in got.elements() if d is not None and (t or "").split())
    assert {d for d in sized} == {c for c in smallest if c is not None} and sized[51] == 1 and sized[53] == 0
    assert {(d, "") for d, t in got if d is not None and not (t or "").split()} == empty
    assert Counter(t for d, t in got.elements() if d is None) == Counter(t for d, t in given if d is None)
    assert got <= Counter(given)


def test_tests_stage_on_odd_rows(spark, sf_dir, awkward):
    given = [(r.doc_id, r.text) for r in awkward.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = Counter(g for g, marked in zip(given, leaks(given, items), strict=True) if not marked[5])
    got = texts(STAGE["benchmark_decontamination"](spark, awkward, sf_dir))
    assert got == want and sum(want.values()) < len(given)


def test_mixing_stage_on_odd_rows(spark, sf_dir, awkward):
    given = Counter((r.source, r.doc_id, r.text) for r in awkward.collect())
    got = Counter((r.source, r.doc_id, r.text) for r in STAGE["source_mixing"](spark, awkward, sf_dir).collect())
    size = lambda t: len((t or "").encode().split())
    sizes, taken, largest = Counter(), Counter(), Counter()
    for (s, _, t), n in given.items():
        sizes[s] += n * size(t)
        largest[s] = max(largest[s], size(t))
    for k, n in got.items():
        assert n <= 3 * given[k]
        taken[k[0]] += n * size(k[2])
    want = targets_by_rounds(dict(sizes))
    assert all(abs(taken[s] - want[s]) <= 2 * largest[s] for s in sizes)


def test_files_stage_on_odd_rows(spark, sf_dir, awkward):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in awkward.collect():
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 1]
        want[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = STAGE["token_files"](spark, awkward, sf_dir).orderBy("start").collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert STAGE["token_files"](spark, none(spark), sf_dir).count() == 0


def test_stages_keep_the_columns(spark, sf_dir):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, none(spark), sf_dir).columns == none(spark).columns


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "benchmark_decontamination", "source_mixing", "token_files"]
    assert len(rows()) > 10


def test_stages_hand_python_small_batches(spark, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 30))
        stage(spark, none(spark), sf_dir)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
