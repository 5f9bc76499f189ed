"""The conversation trie against a brute-force trie over whole texts."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tilespark.llm import prefix_trie
from tilespark.llm.prefix_trie import ShardTrie, common_turns

SCHEMA = "conv_id long, turn long, role string, text string, path int, words string, n string, shard string, depth long, key string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "w", "n", "s", 2, "k") for r in rows], SCHEMA)


def digest(turn):
    return hashlib.md5(f"{len(turn[0].encode())}:{turn[0]}{turn[1]}".encode()).hexdigest()


def by_hand(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn, (role or "", text or "")))
    own = {c: [x for _, x in sorted(t, key=lambda p: (p[0] is not None, p[0] or 0, digest(p[1])))] for c, t in convs.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rebuilt[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        out, todo = [], [p]
        while todo:
            q = todo.pop()
            out.append(q)
            todo += kids[q]
        return out

    rows = []
    for p, m in members.items():
        under = below(p)
        saved = sum((len(members[q]) - 1) * len(WORD.findall(q[-1][1])) for q in under if q)
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p))
        rows.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[q] for q in under), saved,
                     hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def corpus(seed, n=300):
    """Few different turns, so that conversations share much; one in three is the same; some are long."""
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-200, 2000), n):
        size = r.choice([1, 2, 3, 4, 6, 9])
        turns = ["hot one", "hot two", "hot three"] if r.random() < 0.33 else [" ".join(r.choices("ab", k=r.randint(0, 3))) for _ in range(size)]
        rows += [(c, i if r.random() < 0.95 else None, r.choice(["user", "user", None]) if turns[0][:1] != "h" else "user", t or None) for i, t in enumerate(turns)]
    rows += [(4000 + k, i, "user", f"long {i}") for k in range(5) for i in range(150 - k)]
    return rows


@pytest.mark.parametrize("seed, shard_bytes", [(1, 8 << 20), (2, 8 << 20), (3, 64), (4, 400)])
def test_trie_against_brute_force(spark, monkeypatch, seed, shard_bytes):
    monkeypatch.setattr(prefix_trie, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(prefix_trie, "CHUNK", 20)
    rows = corpus(seed)
    assert found(prefix_trie.conversation_trie(table(spark, rows).repartition(7))) == by_hand(rows)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "a b"), (1, 0, "user", "a b"), (1, 0, "system", "c"), (None, 0, "user", "lost"), (None, None, None, None),
            (20, 0, "user", ""), (21, 5, "user", "x\x0by \t"), (22, 0, "user", "w " * 30_000), (23, 0, "us", "er1"), (24, 0, "use", "r1"), (-5, 1, "user", "neg"),
            (43, 0, "user", "gone"), (2**62, 2**62, "user", "far"), (2**62, -(2**62), "user", "first")]
    got = found(prefix_trie.conversation_trie(table(spark, rows)))
    assert got == by_hand(rows)
    assert any(r[1] == 0 and r[2] is None for r in got)


def test_query_against_brute_force(spark, sf_dir):
    from tilespark.llm.queries import op12_prefix_trie

    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    assert found(op12_prefix_trie(spark, sf_dir)) == by_hand(rows)


def test_no_conversations(spark):
    assert prefix_trie.conversation_trie(table(spark, [])).count() == 0
    assert prefix_trie.conversation_trie(table(spark, [(None, 1, "user", "a")])).count() == 0


def test_one_long_conversation_is_one_shard(spark):
    trie = ShardTrie(0, -1, -1)
    trie.add(7, bytes(range(16)) * 20_000, [1] * 20_000)
    trie.finish()
    assert trie.take().num_rows == 20_001
    assert common_turns(b"a" * 64, b"a" * 40 + b"b" * 24) == 2
