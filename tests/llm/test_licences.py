import hashlib

from odd import documents, none, rows

from tilespark.llm import licences
from tilespark.llm.queries import op10_license_scan


def forms(spark, texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.f for r in frame.select("i", licences.canonical(frame.t).alias("f")).orderBy("i").collect()]


def test_canonical_forms(spark):
    a, b, c, d, e = forms(spark, [
        "The  LICENCE, whilst\nCopyright (c) 2020 Someone\nnon-commercial", "the license while noncommercial", "(C) x\n", None, "Sub-licence per cent"])
    assert a == b == "the license while noncommercial" and c == "" and d is None and e == "sublicense percent"


def test_whole_texts_and_lines(spark):
    mit = licences.NOTICES["MIT"][-1]
    docs = [(1, mit), (2, mit.upper().replace("\n", "  ") .replace("COPYRIGHT (C) <YEAR> <COPYRIGHT HOLDERS>", "\nCopyright 1999 me\n")),
            (3, "Some text.\nReleased under the MIT licence\nLicensed under CC BY-NC 4.0."), (4, mit + " more"), (5, None), (6, "")]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(docs, "doc_id long, text string"), licences.known_licences(spark)).collect()}
    assert got[1].whole_licence == got[2].whole_licence == "MIT" and got[1].text_digest == got[2].text_digest
    assert got[3].licences == ["CC-BY-NC-4.0", "MIT"] and got[3].n_notices == 2 and got[3].whole_licence is None
    assert got[4].whole_licence is None and got[5].text_digest == got[6].text_digest == hashlib.sha256(b"").hexdigest()


def test_every_full_text(spark):
    """Each known text, as it is and with other case, line breaks, punctuation, copyright lines and spellings."""
    import re

    known = [(k, t) for k, t in licences.known_texts() if len(t) > 500]
    assert {"Apache-2.0", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "MIT", "ISC", "Artistic-1.0", "GFDL-1.3"} <= {k for k, _ in known}
    docs = []
    for i, (_, t) in enumerate(known):
        lines = [x for x in t.split("\n") if not re.match(r"(?i)\W*(copyright\b|\(c\)|all rights reserved)", x)]
        other = "Copyright 2021 Somebody Else\n" + re.sub(r"\bLICENSE\b", "LICENCE", "\n\n".join(lines).upper()).replace(",", " ,- ")
        docs += [(2 * i, t), (2 * i + 1, other), (-i - 1, t + " and more")]
    got = {r.doc_id: r.whole_licence for r in licences.scan(spark.createDataFrame(docs, "doc_id long, text string"), licences.known_licences(spark)).collect()}
    for i, (k, _) in enumerate(known):
        assert (got[2 * i], got[2 * i + 1], got[-i - 1]) == (k, k, None)


def test_odd_rows_and_nothing(spark):
    known = licences.known_licences(spark)
    assert licences.scan(documents(spark), known).count() == len(rows())
    assert licences.scan(none(spark), known).count() == 0
    assert licences.scan(documents(spark), known.limit(0)).filter("size(licences) > 0 or whole_licence is not null").count() == 0


def test_query_finds_every_notice(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    notices = {t: k for k, ts in licences.NOTICES.items() for t in ts}
    want = {d: ",".join(sorted({notices[x] for x in t.split("\n") if x in notices})) for d, t in docs.items()}
    got = {r.doc_id: r.licences for r in op10_license_scan(spark, sf_dir).collect()}
    assert got == want and any(want.values())
