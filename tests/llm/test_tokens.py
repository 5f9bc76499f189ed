import zlib

import numpy as np
import pytest
from odd import documents, none, rows

from tilespark.llm import token_counts, token_output
from tilespark.llm.tokens import TextEncoder, tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


ODD = ["(the.) 'tis ...x-y_z", "\u0130stanbul \ufb01ne \u212b A\u030a", "a\u0323\u0301b", "<b>bold</b> $5,000.00!", "\x1fline\x0b\x0c", "don't.", "x'S",
       "a<|endoftext|>B (<|EndOfText|>) <|STARTOFTEXT|>", "<|startoftext|>.", "KED\u0130.", "G\u0130TT\u0130!", "(\u0130)", "\u095c,", "\ufb2a.", "\u03a3\u03a3 \u03a3", "a\x01b",
       " " * 30_000 + "a", "\n" * 12_000, "x" * 50_000, "</w> a</w>"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_tokenizers(name):
    """Every code point between letters, digits, marks and spaces, and random strings of awkward ones."""
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    r = random.Random(7)
    some = [*map(chr, range(32, 127)), *"\u00e9\u00df\u00c0\u6f22\u0301\u0307\u05c1\u0130\u03a3\u03c3\u03c2\u0921\u093c\u05e9\u1e9e\ufb01\u2019\u201c\U0001f600\u200d\ufeff\u0663\u2167\u00bd\t\n\r\x0b\x1c\x85\xa0",
            "'s", "'ll", "  ", "<|endoftext|>", "</w>", "\x01"]
    texts = [f"a{c}b {c}1{c}. {c} {c}{c}\n{c}'s{c} x" for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"]
    texts += ["".join(r.choices(some, k=r.randint(1, 60))) for _ in range(40_000)] + ODD + [t for _, t, *_ in rows() if t]
    whole, coder = Tokenizer.from_file(tokenizer_path(name)), TextEncoder(tokenizer_path(name))
    assert coder.fast is not None
    for at in range(0, len(texts), 100_000):
        part = texts[at:at + 100_000]
        assert [i for i, e in enumerate(whole.encode_batch(part, add_special_tokens=False)) if coder.ids(part[i]) != e.ids] == []
    flat, cuts = coder.encode(pa.array([None, *ODD, ""]), 5)
    assert [flat[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] == [ids_of(whole, t) + [5] for t in [None, *ODD, ""]]
    assert coder.lengths(pa.array([None, *ODD])).tolist() == [len(ids_of(whole, t)) for t in [None, *ODD]]


def expected(tokenizer, pairs):
    start, out = 0, []
    for d, t in pairs:
        ids = ids_of(tokenizer, t) + [1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_hold_every_document(spark, tokenizer):
    got = [tuple(r) for r in token_output.read_digests(token_output.write_tokens(documents(spark))).orderBy("start").collect()]
    at = {}
    for r in rows():
        at.setdefault(r[0], []).append(r[1])
    assert [g[0] for g in got] == sorted((r[0] for r in rows()), key=lambda d: (d is not None, d or 0))
    start = 0
    for d, s, n, crc in got:
        assert s == start
        start += n
        choices = [ids_of(tokenizer, t) + [1] for t in at[d]]
        assert (n, crc) in [(len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for c in choices]


def test_query_matches_direct_encoding(spark, sf_dir, tokenizer):
    from tilespark.llm.queries import op5_token_files

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = [tuple(r) for r in op5_token_files(spark, sf_dir).orderBy("doc_id").collect()]
    assert got == expected(tokenizer, [(r.doc_id, r.text) for r in docs])


def test_requested_documents_only(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    catalogue = token_output.write_tokens(docs, frame_bytes=4096)
    assert catalogue.count() > 20
    got = {r.doc_id: r.ids for r in token_output.read_documents(catalogue, docs.filter("doc_id in (3, 50)")).collect()}
    want = {r.doc_id: ids_of(tokenizer, r.text) + [1] for r in docs.filter("doc_id in (3, 50)").collect()}
    assert got == want


def test_damage_is_noticed(spark, sf_dir, tmp_path):
    folder = str(tmp_path / "shards")
    catalogue = token_output.write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    path = catalogue.head().shard
    data = bytearray(open(path, "rb").read())
    with open(path, "rb") as f:
        reader = token_output.ShardReader(f)
        assert len(reader) >= 1 and token_output.unpack(reader.content(0))[0]
    data[-10] ^= 1  # a checksum of the table
    open(path, "wb").write(bytes(data))
    with open(path, "rb") as f, pytest.raises(ValueError, match="damaged"):
        reader = token_output.ShardReader(f)
        reader.content(len(reader) - 1)


def test_no_documents(spark):
    catalogue = token_output.write_tokens(none(spark))
    assert catalogue.count() == 0 and token_output.read_digests(catalogue).count() == 0
    assert token_counts.length_histogram(token_counts.token_lengths(none(spark))).count() == 0


def test_histogram_against_brute_force(spark, tokenizer):
    n = [len(ids_of(tokenizer, r[1])) for r in rows()]
    found = token_counts.length_histogram(token_counts.token_lengths(documents(spark)))
    got = {r.context_limit: r for r in found.collect()}
    assert set(got) == set(n)
    for limit, r in got.items():
        assert r.n_docs == n.count(limit) and r.n_longer == sum(x > limit for x in n) and r.docs_upto == len(n) - r.n_longer
        assert r.truncated_tokens == sum(min(x, limit) for x in n) and r.total_tokens == sum(n)
        assert r.quantile == pytest.approx(r.docs_upto / len(n))
    limits = spark.createDataFrame([(0,), (1,), (5,), (5,), (100,), (2047,), (2048,), (30_000,), (10**9,), (None,)], "context_limit long")
    asked = token_counts.at_limits(found, limits).collect()
    assert len(asked) == 8 and token_counts.at_limits(found.limit(0), limits).count() == 0
    for r in asked:
        assert (r.n_longer, r.truncated_tokens) == (sum(x > r.context_limit for x in n), sum(min(x, r.context_limit) for x in n))


def test_counts_of_whole_table(spark, sf_dir, tokenizer):
    from collections import Counter

    from tilespark.llm.queries import op2_token_counts

    n = Counter(len(ids_of(tokenizer, r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    assert {r.context_limit: r.n_docs for r in op2_token_counts(spark, sf_dir).collect()} == dict(n)
