"""Prefix trie of conversations, by splitters and a skeleton.

A conversation is a path: a digest of 16 bytes for each turn, one after the other, so that a node of the trie is a
prefix and an order by bytes lists the trie depth first. Paths are sorted over range partitions, the shards. The
splitters between shards are the paths at which they begin; a node lies in several shards only if it is on the
path to a splitter, above the depth at which that path leaves the one before it. These nodes are the skeleton. All that a
task needs to know of it is that depth for the two ends of its shard, so two integers a shard are broadcast,
however long paths are.

Each shard is read once, with the current path on a stack, and finishes all its other nodes. Of a skeleton
node it gives partial aggregates, made so that they add up: a node counts as a child in the first shard that holds it
and as a leaf in the last, and saved tokens are members times words, less the words once in the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilespark.llm.common import BLANK, columns, stored

TURN = 16
GROUP = 20
HEADS = 4
SHARD_BYTES = 8 << 20
CHUNK = 1 << 20
SALTS = 32

NODE = ("kind int, node binary, depth long, conv_id long, parent binary, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string, shard int, chunk int, ends binary")
_NODE = pa.schema([("kind", pa.int32()), ("node", pa.binary()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent", pa.binary()), ("parent_conv_id", pa.int64()),
                   ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
                   ("shard", pa.int32()), ("chunk", pa.int32()), ("ends", pa.binary())])
WHOLE, PARTIAL, ENDS = 0, 1, 2
NOTHING = hashlib.sha256(b"").hexdigest()


def n_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    inner = F.regexp_replace(text, f"^{BLANK}|{BLANK}$", "")
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, BLANK)))


def conversation_paths(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, path, words``: digests of a conversation's turns in order, and the number of words of each.

    Turns are ordered by ``turn``, null first, and those at one place by their digest; repeated rows are turns each. Null
    roles and texts are empty. Rows without a conversation are left out. A conversation is one row of 20 bytes a
    turn; texts don't travel. Other columns are not read. No rows: no conversations.
    """
    rows = columns(turns, conv_id=F.col(f"`{conv_id}`").cast("long"), turn=F.col(f"`{turn}`").cast("long"),
                   role=F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")), text=F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    key = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    rows = rows.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", key.alias("key"), n_words(F.col("text")).cast("int").alias("words"))
    found = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "key", "words"))).alias("t"))
    return found.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda t: t.key), "")).alias("path"), F.transform("t", lambda t: t.words).alias("words"))


def rebuilt_paths(paths: DataFrame, group: int = GROUP, heads: int = HEADS) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation ``c - c % group``, where h is the checksum of c's
    decimals modulo ``heads``: all of them if there are fewer, none if there is no such conversation."""
    c, most = F.col("conv_id"), heads - 1
    first = paths.filter(c % group == 0).select(c.alias("_head"), F.substring("path", 1, TURN * most).alias("_path"), F.slice("words", 1, most).alias("_words"))
    h = (F.crc32(c.cast("string").cast("binary")) % heads).cast("int")
    met = paths.withColumn("_h", h).join(first, c - c % group == F.col("_head"), "left")
    n = F.col("_h")
    head = F.coalesce(F.substring(F.col("_path"), F.lit(1), n * TURN), F.lit(b""))
    rest = F.substring(F.col("path"), n * TURN + 1, F.octet_length("path"))
    words = F.concat(F.coalesce(F.slice(F.col("_words"), F.lit(1), n), F.array().cast("array<int>")), F.slice(F.col("words"), n + 1, F.size("words")))
    return met.select("conv_id", F.concat(head, rest).alias("path"), words.alias("words"))


def common_turns(a: bytes, b: bytes) -> int:
    """Number of leading turns that two paths share."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        at = (low + high + 1) // 2
        if a[TURN * low:TURN * at] == b[TURN * low:TURN * at]:
            low = at
        else:
            high = at - 1
    return low


def _shards(paths: DataFrame) -> DataFrame:
    """The paths in order, stored, with their ``shard``; ``edge`` marks the first and the last row of each."""
    spark = paths.sparkSession
    paths = stored(paths, "paths")
    size = paths.agg(F.sum(F.octet_length("path"))).head()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, size // SHARD_BYTES)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, first = TaskContext.get().partitionId(), None, True
        for batch in batches:
            if not len(batch):
                continue
            if before is not None:
                yield flagged(before, part, first, False)
                first = False
            before = batch
        if before is not None:
            yield flagged(before, part, first, True)

    def flagged(batch: pa.RecordBatch, part: int, first: bool, last: bool) -> pa.RecordBatch:
        edge = [False] * len(batch)
        edge[0], edge[-1] = edge[0] or first, (edge[-1] or last) if len(batch) > 1 else (first or last)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(batch), pa.int32()), pa.array(edge)], ["conv_id", "path", "words", "shard", "edge"])

    order = ("path", "conv_id")
    rows = paths.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    return stored(rows.mapInArrow(mark, "conv_id long, path binary, words array<int>, shard int, edge boolean"), "shards")


def _splitters(shards: DataFrame) -> dict[int, tuple[int, int]]:
    """For each shard that has rows the depth down to which its first path is the last path of the shard before, and
    its last one the first of the shard after; -1 if there is none. Two rows a shard are compared."""
    edges = shards.filter("edge").withColumn("before", F.lag("path").over(Window.orderBy("path", "conv_id"))).withColumn(
        "prior", F.lag("shard").over(Window.orderBy("path", "conv_id")))
    edges = edges.filter(F.col("prior").isNull() | (F.col("prior") != F.col("shard"))).select("shard", "before", "path")

    def depth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = [-1 if b is None else common_turns(b, p) for b, p in zip(batch.column("before").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(shared, pa.int32())], ["shard", "shared"])

    found = sorted((r.shard, r.shared) for r in edges.mapInArrow(depth, "shard int, shared int").collect())
    after = [*(s for _, s in found), -1][1:]
    return {shard: (shared, then) for (shard, shared), then in zip(found, after, strict=True)}


class _Open:
    """A node on the current path: what its members so far add up to."""

    __slots__ = ("words", "opened_first", "n", "least", "has_child", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, words: int, opened_first: bool):
        self.words, self.opened_first = words, opened_first
        self.n = self.children = self.leaves = self.saved = 0
        self.least, self.has_child, self.ends, self.waiting = None, False, [], []


class ShardTrie:
    """Reads the sorted paths of a shard and gives rows of ``NODE``."""

    def __init__(self, shard: int, shared_before: int, shared_after: int):
        self.shard, self.shared_before, self.shared_after = shard, shared_before, shared_after
        self.open: list[_Open] = []
        self.path, self.ready = b"", []

    def add(self, conv_id: int, path: bytes, words: list[int]) -> None:
        first = not self.open
        if first:
            self.open.append(_Open(0, True))
        else:
            keep = common_turns(self.path, path)
            while len(self.open) - 1 > keep:
                self._close(False)
        self.path = path
        for w in words[len(self.open) - 1:]:
            self.open.append(_Open(w, first))
        top = self.open[-1]
        top.n += 1
        top.least = conv_id if top.least is None else min(top.least, conv_id)
        top.ends.append(conv_id)

    def finish(self) -> None:
        while self.open:
            self._close(True)

    def _digest(self, depth: int) -> bytes:
        return hashlib.blake2b(self.path[:TURN * depth], digest_size=16).digest()

    def _close(self, at_end: bool) -> None:
        node, depth = self.open.pop(), len(self.open)
        seen_before = node.opened_first and depth <= self.shared_before
        goes_on = at_end and depth <= self.shared_after
        node.leaves += not node.has_child and not goes_on
        node.saved += node.n * node.words - (0 if seen_before else node.words)
        totals = (node.n, node.children, node.leaves, node.saved)
        parent = self.open[-1] if self.open else None
        if seen_before or goes_on:  # a skeleton node, and so is its parent
            key = self._digest(depth)
            above = self._digest(depth - 1) if depth else None
            self.ready.append((PARTIAL, key, depth, node.least, above, None, *totals, None, self.shard, None, None))
            text, size, chunk = [], 0, 0
            for c in node.ends:
                text.append(b"%d" % c)
                size += len(text[-1]) + 1
                if size >= CHUNK:
                    self.ready.append((ENDS, key, None, None, None, None, *[None] * 4, None, self.shard, chunk, b",".join(text)))
                    text, size, chunk = [], 0, chunk + 1
            if text:
                self.ready.append((ENDS, key, None, None, None, None, *[None] * 4, None, self.shard, chunk, b",".join(text)))
            self.ready += [(WHOLE, None, d, c, key, None, *rest, None, None, None) for d, c, *rest in node.waiting]
        else:
            ends = hashlib.sha256(b",".join(b"%d" % c for c in node.ends)).hexdigest() if node.ends else NOTHING
            self.ready += [(WHOLE, None, d, c, None, node.least, *rest, None, None, None) for d, c, *rest in node.waiting]
            if parent is None:
                self.ready.append((WHOLE, None, depth, node.least, None, None, *totals, ends, None, None, None))
            else:
                parent.waiting.append((depth, node.least, *totals, ends))
        if parent is not None:
            parent.n += node.n
            parent.least = node.least if parent.least is None else min(parent.least, node.least)
            parent.has_child = True
            parent.children += not seen_before
            parent.leaves += node.leaves
            parent.saved += node.saved

    def take(self) -> pa.RecordBatch:
        made, self.ready = self.ready, []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), _NODE.types, strict=True)], schema=_NODE)


def _whole_ends(partial: DataFrame) -> DataFrame:
    """``_node, _ends``: the digest over the ids that end in a skeleton node, which its chunks give in order. It has to be taken
    in one run; chunks pass through one by one."""
    tasks = int(partial.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            out = []
            for key, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if key != node:
                    if node is not None:
                        out.append((node, sha.hexdigest()))
                    node, sha = key, hashlib.sha256(ends)
                else:
                    sha.update(b",")
                    sha.update(ends)
            if out:
                yield result(out)
        if node is not None:
            yield result([(node, sha.hexdigest())])

    def result(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["_node", "_ends"])

    rows = partial.filter(F.col("kind") == ENDS).select("node", "shard", "chunk", "ends").repartition(tasks, "node").sortWithinPartitions("node", "shard", "chunk")
    return rows.mapInArrow(run, "_node binary, _ends string")


def trie(paths: DataFrame) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256``. Paths of no turns end in the root. No paths: no nodes."""
    shards = _shards(paths)
    splitters = _splitters(shards)
    n = max(1, len(splitters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: ShardTrie | None = None
        for batch in batches:
            for shard, c, path, words in zip(*(batch.column(k).to_pylist() for k in ("shard", "conv_id", "path", "words")), strict=True):
                if at is None or at.shard != shard:
                    if at is not None:
                        at.finish()
                        yield at.take()
                    at = ShardTrie(shard, *splitters[shard])
                at.add(c, path, words)
                if len(at.ready) >= 10_000:
                    yield at.take()
        if at is not None:
            at.finish()
            yield at.take()

    rows = shards.select("shard", "conv_id", "path", "words").repartition(n, "shard").sortWithinPartitions("shard", "path", "conv_id")
    made = stored(rows.mapInArrow(run, NODE), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    skeleton = made.filter(F.col("kind") == PARTIAL).groupBy("node").agg(
        F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("parent").alias("parent"), *sums)
    ends = _whole_ends(made)
    skeleton = skeleton.join(ends, F.col("node") == F.col("_node"), "left").withColumn("ends_sha256", F.coalesce("_ends", F.lit(NOTHING))).drop("_node", "_ends")
    skeleton = stored(skeleton, "skeleton")
    names = ["conv_id", "depth", "parent", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole = made.filter(F.col("kind") == WHOLE).select(*names)
    rows = whole.unionByName(skeleton.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*names))
    # children of one skeleton node may be a large part of all nodes: they are dealt out, and the few skeleton nodes repeated
    above = skeleton.select(F.col("node").alias("_node"), F.col("conv_id").alias("_conv"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_to"))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)).cast("int"))
    found = rows.join(above, (F.col("parent") == F.col("_node")) & (F.col("_salt") == F.col("_to")), "left")
    return found.select("conv_id", "depth", F.coalesce("parent_conv_id", "_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(turns: DataFrame, **names: str) -> DataFrame:
    """The trie of rebuilt conversations, from a table of turns."""
    return trie(rebuilt_paths(conversation_paths(turns, **names)))
