from collections import Counter

from odd import documents, none, rows

from tilespark.llm import quality_rules
from tilespark.llm.queries import op8_quality_rules


def brute(text):
    w = (text or "").encode().split()
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    windows = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    hit = {i for k in range(len(w) - 7) if windows[tuple(w[k:k + 8])] > 1 for i in range(k, k + 8)}
    chars, symbols = sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text or "")
    return len(w), chars, symbols, len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = op8_quality_rules(spark, sf_dir).collect()
    assert sorted(tuple(r)[:7] for r in got) == sorted((r.doc_id, *brute(r.text)) for r in docs)
    assert not any(r.base_failed and r.kept for r in got) and any(r.kept for r in got)


def test_odd_rows(spark):
    more = [(50, "a b c d e f g h a b c d e f g h a b"), (51, "x " * 40), (52, "l1 a\nl1 a\n\n \nl2\r\nl1 a"), (53, "one\x0btwo\x1cthree")]
    docs = documents(spark).select("doc_id", "text", "source").unionByName(
        spark.createDataFrame([(d, t, "b") for d, t in more], "doc_id long, text string, source string"))
    got = quality_rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    want = [(r[0], *brute(r[1])) for r in rows()] + [(d, *brute(t)) for d, t in more]
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(30)), "short"
    docs = [("big", good)] * 190 + [("big", bad)] * 10 + [("junk", bad)] * 90 + [("junk", good)] * 10 + [("tiny", bad)] + [(None, good)] * 50
    frame = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(docs)], "doc_id long, text string, source string")
    found = quality_rules.judge(frame).groupBy("host").agg({"host_out": "max", "kept": "max", "doc_id": "count"}).collect()
    out = {r.host: r["max(host_out)"] for r in found}
    assert out == {"big": False, "junk": True, "tiny": out["tiny"], None: False}
    shares = {r.host: r.share_short for r in quality_rules.host_verdicts(quality_rules.figures(frame)).collect()}
    assert shares["junk"] < 0.9 and 0.05 < shares["big"] < shares["tiny"] < 1  # one bad document does not make a share of 1


def test_nothing(spark):
    assert quality_rules.judge(none(spark)).count() == 0
