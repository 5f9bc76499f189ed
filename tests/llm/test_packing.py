"""Packing against a brute-force concatenation, and its sequences against its pieces."""

import zlib

import numpy as np
import pytest
from odd import documents, none, rows

from tilespark.llm import packing
from tilespark.llm.tokens import tokenizer_path


@pytest.fixture(scope="module")
def ids_of():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return lambda text: [*whole.encode(text or "", add_special_tokens=False).ids, 0]


def by_hand(docs, length):
    """``docs``: ids in order. Pieces and sequences of their concatenation."""
    out, at, stream = [], 0, []
    for d, ids in docs:
        start = 0
        while start < len(ids):
            size = min(length - at % length, len(ids) - start)
            out.append((d, start, size, zlib.crc32(np.array(ids[start:start + size], "<u4").tobytes()), len(ids), at // length, at % length))
            start, at = start + size, at + size
        stream += ids
    return out, [stream[i:i + length] for i in range(0, len(stream), length)]


NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def test_query_against_brute_force(spark, sf_dir, ids_of):
    from tilespark.llm.queries import op11_packing

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    want, sequences = by_hand([(r.doc_id, ids_of(r.text)) for r in docs], 1024)
    got = op11_packing(spark, sf_dir).orderBy("sequence_id", "offset").collect()
    assert [tuple(r[c] for c in NAMES) for r in got] == want
    assert {r.padded_length for r in got if r.sequence_id < len(sequences) - 1} == {1024}
    assert got[-1].padded_length == packing.padded_length(len(sequences[-1]), 1024)


@pytest.mark.parametrize("length", [7, 64, 100_000_000])
def test_odd_rows_and_sequences(spark, ids_of, length):
    encoded = packing.encode(documents(spark).repartition(5))
    placed = packing.placed(encoded)
    got = packing.cut_pieces(placed, length).orderBy("sequence_id", "offset").collect()
    order = []  # repeated ids: any order of their texts, each row once
    for r in got:
        if r.start == 0:
            order.append((r.doc_id, r.doc_tokens, r.ids_crc32))
    key = lambda d: (d is not None, d or 0)
    assert [o[0] for o in order] == sorted((r[0] for r in rows()), key=key)
    left, docs = [(r[0], ids_of(r[1])) for r in rows()], []
    for d, n, crc in order:
        i = next(i for i, (e, ids) in enumerate(left) if e == d and len(ids) == n and zlib.crc32(np.array(ids[:min(n, length - sum(len(x) for _, x in docs) % length)], "<u4").tobytes()) == crc)
        docs.append(left.pop(i))
    want, sequences = by_hand(docs, length)
    assert [tuple(r[c] for c in NAMES) for r in got] == want
    made = packing.write_sequences(placed, length=length).orderBy("sequence_id").collect()
    assert [r.sequence_id for r in made] == list(range(len(sequences)))
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in made] == sequences
    assert [(p.doc_id, p.start, p.length, p.doc_tokens, r.sequence_id, p.offset) for r in made for p in r.pieces] == [(w[0], w[1], w[2], w[4], w[5], w[6]) for w in want]


def test_runs_in_any_order_give_the_same_sequences(spark, ids_of):
    placed = packing.placed(packing.encode(documents(spark)))
    a = {r.sequence_id: (bytes(r.ids), r.pieces) for r in packing.write_sequences(placed, length=50).collect()}
    b = {r.sequence_id: (bytes(r.ids), r.pieces) for r in packing.write_sequences(placed.repartition(6), length=50).collect()}
    assert a == b and len(a) > 100


def test_powers_of_two_are_not_padded():
    assert [packing.padded_length(n, 16) for n in (1, 2, 3, 8, 9, 16)] == [1, 2, 16, 8, 16, 16]


def test_no_documents(spark):
    assert packing.pack(none(spark)).count() == 0
    assert packing.write_sequences(packing.placed(packing.encode(none(spark)))).count() == 0
