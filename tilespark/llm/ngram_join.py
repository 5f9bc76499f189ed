"""N-gram Jaccard join by vertical partitioning.

All n-grams have one global order: those found often last, the others by their hash. A document's
set is cut along that order into fragments. If two sets are similar enough, the first fifth of each
(the prefix) holds a common n-gram, so sets meet on prefix n-grams only; for the pairs that meet, the
fragments are joined one by one, each counts the common n-grams in its part, and the sums per pair
decide exactly.

Documents with the same set form one class, of which one is compared. In a group that meets on an
n-gram the document with most of its set still to come leads, and all others are compared to it;
groups that its links join are done. For what is left, another leader is tried, and then all
pairs that can still be similar and are not yet joined are compared. So large groups of copies take as
many comparisons as they have members, and no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import Lazy, columns, flat_words, fresh, pieces, release, stored
from tilespark.llm.components import components
from tilespark.operators.hot import SALT, deal_hot

N = 5
PERCENT = 80
#: N-grams that the order puts last; a bound on what is sent to all tasks, not on what is compared.
FREQUENT = 1 << 16
FRAGMENTS = 8
#: Bytes of text whose n-grams are counted together, to find the frequent ones.
SPAN = 16 << 20
#: Bytes of text that are cut into words at once.
PIECE = 1 << 20
#: A batch that holds a prefix n-gram this often knows that it has company, and deals its rows to any task.
REPEATED = 2
#: Rows of one n-gram that one task compares at most.
MOST = 20_000

_U = np.uint64


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def word_hashes() -> Lazy:
    """A table of words' hashes; each task has its own, so that it goes with the task."""
    return Lazy(xxhash.xxh3_64_intdigest)


def ngram_sets(column: pa.Array, n: int = N, known: Lazy | None = None) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text of fewer words is one n-gram, of none has none."""
    words, ends = flat_words(column)
    h = np.fromiter(map((known if known is not None else word_hashes()).__getitem__, words), _U, len(words))
    del words[:]
    rolled = np.zeros(max(0, len(h) - n + 1), _U)
    for k in range(n):
        rolled = rolled * _U(0x9E3779B97F4A7C15) + h[k:len(h) - n + 1 + k]
    rolled = _mixed(rolled)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        if b - a >= n:
            yield np.unique(rolled[a:b - n + 1])
        elif b > a:
            yield _mixed(np.array([_short(h[a:b])], _U))
        else:
            yield np.empty(0, _U)


def _short(h: np.ndarray) -> int:
    """Hash of a text of fewer words than an n-gram."""
    return xxhash.xxh3_64_intdigest(h.tobytes(), seed=N)


def _signature(s: np.ndarray) -> tuple[int, int]:
    d = blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def prefix_length(size: int, percent: int = PERCENT) -> int:
    return size - -(-size * percent // 100) + 1


class Order:
    """The global order: n-grams that are not frequent by hash, then the frequent by count and hash."""

    def __init__(self, frequent: list[tuple[int, int]]):
        rows = sorted((t & 0xFFFFFFFFFFFFFFFF, c) for t, c in frequent)
        self.hash = np.array([t for t, _ in rows], _U)
        self.count = np.array([c for _, c in rows], np.int64)

    def counts(self, s: np.ndarray) -> np.ndarray:
        """Estimated count of each n-gram, 0 if it is not frequent."""
        if not len(self.hash):
            return np.zeros(len(s), np.int64)
        at = np.minimum(np.searchsorted(self.hash, s), len(self.hash) - 1)
        return np.where(self.hash[at] == s, self.count[at], 0)

    def first(self, s: np.ndarray, k: int) -> np.ndarray:
        """The first ``k`` of a set that is sorted by hash."""
        some = s[:k + k // 2 + 8]
        rare = some[self.counts(some) == 0]
        if len(rare) >= k:
            return rare[:k]
        c = self.counts(s)
        return s[np.lexsort((s, c))][:k]


def _repeated(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Values that all arrays together hold three times or more, and how often; the list is emptied."""
    token = np.concatenate([np.empty(0, _U), *held])
    held.clear()
    token.sort()
    third, more = np.unique(token[2:][token[2:] == token[:-2]], return_counts=True)
    return third, more + 2


def _measure(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """One pass over the texts: each row's class and size, and n-grams that batches hold repeatedly."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known = ["kind", "doc_id", "text_hash", "hi", "lo", "size", "token", "times"], word_hashes()
        seen, held, width = set(), [], 0

        def repeated() -> pa.RecordBatch:
            token, times = _repeated(held)
            seen.clear()
            keep = np.argsort(-times, kind="stable")[:FREQUENT // 2]
            m, none = len(keep), pa.nulls(len(keep), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), none, none, none, none, none,
                                               pa.array(token[keep].view(np.int64)), pa.array(times[keep].astype(np.int64))], names)

        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                hi, lo, size = [], [], []
                for s in ngram_sets(piece.column("text"), n, known):
                    sig = _signature(s) if len(s) else (0, 0)
                    hi.append(sig[0])
                    lo.append(sig[1])
                    size.append(len(s))
                    if sig not in seen:
                        seen.add(sig)
                        held.append(s)
                m = len(size)
                none = pa.nulls(m, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.zeros(m, np.int32)), piece.column("doc_id"), piece.column("text_hash"), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()),
                    pa.array(size, pa.int64()), none, none], names)
                width += piece.column("text").nbytes
                if width >= SPAN:
                    yield repeated()
                    width = 0
            release()
        yield repeated()

    rows = docs.mapInArrow(run, "kind int, doc_id long, text_hash long, hi long, lo long, size long, token long, times long")
    rows = stored(rows, "sets")
    return (rows.filter("kind = 0").select("doc_id", "text_hash", "hi", "lo", "size"), rows.filter("kind = 1").select("token", "times"))


def _order(repeated: DataFrame) -> Order:
    top = repeated.groupBy("token").agg(F.sum("times").alias("times")).orderBy(F.col("times").desc(), "token").limit(FREQUENT)
    return Order([(r.token, r.times) for r in top.collect()])  # bounded by FREQUENT


def _prefixes(docs: DataFrame, order: Order, n: int, percent: int) -> DataFrame:
    """``cid, hi, lo, size, prefix``: the classes and their prefixes, five bytes of hash per n-gram.

    A hash that two n-grams share here only makes them meet."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, known = shared.value, word_hashes()
        for batch in batches:
            seen = set()
            for piece in pieces(batch, "text", PIECE):
                rows: list[list] = [[], [], [], []]
                for s in ngram_sets(piece.column("text"), n, known):
                    if not len(s) or (sig := _signature(s)) in seen:
                        continue
                    seen.add(sig)
                    first = order.first(s, prefix_length(len(s), percent))
                    packed = np.ascontiguousarray(first.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
                    for r, v in zip(rows, (*sig, len(s), packed), strict=True):
                        r.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                                                 ["hi", "lo", "size", "prefix"])
            release()

    found = docs.select("text").mapInArrow(run, "hi long, lo long, size long, prefix binary")
    found = found.groupBy("hi", "lo").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"))
    return stored(found.select(F.monotonically_increasing_id().alias("cid"), "hi", "lo", "size", "prefix"), "classes", free=True)


def _meetings(classes: DataFrame) -> DataFrame:
    """``token, cid, left, size, met``: prefix n-grams that two classes or more hold; ``left`` is how much of the set
    the n-gram and those after it in the order make up, ``met`` how many such n-grams the class has.

    A batch in which an n-gram repeats deals its rows to any tasks, where they are kept as they are, and sends one row to the n-gram's own
    task, where the others then find company: so that task has one row a batch at most."""
    spark = classes.sparkSession

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [p.as_py() for p in batch.column("prefix")]
            k = np.array([len(p) // 5 for p in packed], np.int64)
            raw = np.zeros((int(k.sum()), 8), np.uint8)
            raw[:, 3:] = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, 5)
            token = raw.view(">u8").ravel().astype(np.int64)
            cid, size = (np.repeat(np.asarray(batch.column(c)), k) for c in ("cid", "size"))
            left = size - (np.arange(len(token)) - np.repeat(np.cumsum(k) - k, k))
            _, first, back, times = np.unique(token, return_index=True, return_inverse=True, return_counts=True)
            salt = np.where(times[back] >= REPEATED, cid % 64, -1)
            mark = first[times >= REPEATED]
            cols = [np.r_[token, token[mark]], np.r_[cid, np.full(len(mark), -1)], np.r_[left, left[mark]], np.r_[size, size[mark]], np.r_[salt, np.full(len(mark), -1)]]
            for a in range(0, len(cols[0]), 50_000):
                b = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array(x[b]) for x in cols], ["token", "cid", "left", "size", "salt"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[np.asarray(c) for c in b.columns] for b in batches]
        if not held:
            return
        token, cid, left, size, salt = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        by = np.argsort(token, kind="stable")
        ordered = token[by]
        same = ordered[1:] == ordered[:-1]
        keep = by[(np.r_[False, same] | np.r_[same, False] | (salt[by] >= 0)) & (cid[by] >= 0)]
        for a in range(0, len(keep), 50_000):
            b = keep[a:a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(x[b]) for x in (token, cid, left, size)], ["token", "cid", "left", "size"])

    total = classes.agg(F.sum(F.octet_length("prefix"))).head()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), total // 5_000_000)
    dealt = classes.select("cid", "size", "prefix").mapInArrow(rows, "token long, cid long, left long, size long, salt long").repartition(tasks, "token", "salt")
    met = stored(dealt.mapInArrow(meet, "token long, cid long, left long, size long"), "meetings", free=True)
    counts = met.groupBy(F.col("cid").alias("_cid")).agg(F.count(F.lit(1)).alias("met"))
    return stored(met.join(counts, F.col("cid") == F.col("_cid")).drop("_cid"), "meetings", free=True)


def _fragments(docs: DataFrame, found: DataFrame, classes: DataFrame, pairs: DataFrame, order: Order, n: int) -> DataFrame:
    """``cid, part, grams``: the whole sets, cut into fragments, of the classes in ``pairs``.

    One row of each class is read again; where rows are repeated, its fragments may be there twice."""
    shared = docs.sparkSession.sparkContext.broadcast(order)
    ids = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    wanted = classes.select("cid", "hi", "lo").join(ids, "cid")
    rows = found.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"))
    rows = wanted.join(rows, ["hi", "lo"]).select("cid", F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), "row.*").withColumnsRenamed({"doc_id": "_d", "text_hash": "_t"})
    picked = docs.join(rows, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_t"))).select("text", "cid", "_hi", "_lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, known = shared.value, word_hashes()
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                out: list[list] = [[], [], []]
                keys = zip(*(piece.column(c).to_pylist() for c in ("cid", "_hi", "_lo")), strict=True)
                for s, (cid, hi, lo) in zip(ngram_sets(piece.column("text"), n, known), keys, strict=True):
                    if _signature(s) != (hi, lo):
                        continue
                    part = np.where(order.counts(s) > 0, FRAGMENTS - 1, (s >> _U(40)) * _U(FRAGMENTS - 1) >> _U(24))
                    for p in range(FRAGMENTS):
                        if len(grams := s[part == p]):
                            for r, v in zip(out, (cid, p, grams.tobytes()), strict=True):
                                r.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], ["cid", "part", "grams"])
            release()

    return stored(picked.mapInArrow(run, "cid long, part int, grams binary"), "fragments", free=True)


def overlaps(pairs: DataFrame, fragments: DataFrame) -> DataFrame:
    """``a, b, common``: partial overlaps counted per fragment, then summed per pair."""
    left = fragments.select(F.col("cid").alias("b"), "part", F.col("grams").alias("grams_b"))
    right = fragments.select(F.col("cid").alias("_a"), F.col("part").alias("_part"), F.col("grams").alias("grams_a"))
    both = pairs.join(left, "b").join(right, (F.col("a") == F.col("_a")) & (F.col("part") == F.col("_part"))).select("a", "b", "part", "grams_a", "grams_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = [len(np.intersect1d(np.frombuffer(x, _U), np.frombuffer(y, _U), assume_unique=True))
                      for x, y in zip(batch.column("grams_a").to_pylist(), batch.column("grams_b").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("part"), pa.array(common, pa.int64())], ["a", "b", "part", "common"])
            release()

    counted = both.mapInArrow(run, "a long, b long, part int, common long")
    return counted.groupBy("a", "b", "part").agg(F.max("common").alias("common")).groupBy("a", "b").agg(F.sum("common").alias("common"))


def _can_link(percent: int) -> Column:
    """Sizes, the position of the first common n-gram and the number of prefix n-grams that others hold leave
    room for enough common ones.

    Up to where the shorter of the two prefixes ends, common n-grams are in both prefixes; after that they
    are in the rest of one of the sets.
    """
    enough = percent * (F.col("size") + F.col("_size"))
    longest = F.greatest("size", "_size")
    rest = F.floor((longest * percent + 99) / 100) - 1
    return ((100 + percent) * F.least("left", "_left") >= enough) & ((100 + percent) * (F.least("met", "_met") + rest) >= enough)


def _links(pairs: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """The pairs that are similar, of ``a, b`` with sizes ``size_a, size_b``."""
    found = overlaps(pairs.select("a", "b"), fragments).withColumnsRenamed({"a": "_a", "b": "_b"})
    joined = pairs.join(found, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
    return joined.filter(100 * F.col("common") >= percent * (F.col("size_a") + F.col("size_b") - F.col("common"))).select("a", "b")


def _distinct_pairs(rows: DataFrame) -> DataFrame:
    return rows.groupBy("a", "b").agg(F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"))


def _labelled(meetings: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return meetings.withColumn("comp", F.col("cid"))
    return meetings.join(labels, F.col("cid") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "cid")).drop("node", "component")


def _leaders(rows: DataFrame) -> DataFrame:
    """Of each n-gram: the member with most of its set still to come, by a hash among equals."""
    key = (F.col("size") - F.col("left")) * F.lit(1 << 44) + F.abs(F.xxhash64("cid")) % F.lit(1 << 44)
    return rows.groupBy(F.col("token").alias("_token")).agg(
        F.min_by("cid", key).alias("_cid"), F.min_by("left", key).alias("_left"), F.min_by("size", key).alias("_size"),
        F.min_by("met", key).alias("_met"), F.min_by("comp", key).alias("_comp"))


def _against_leaders(rows: DataFrame, leaders: DataFrame, percent: int) -> DataFrame:
    dealt, repeated = deal_hot(rows, leaders.withColumnRenamed("_token", "token"), ["token"], ["cid"], MOST)
    met = dealt.join(repeated, ["token", SALT]).filter((F.col("comp") != F.col("_comp")) & _can_link(percent))
    return _distinct_pairs(met.select(F.col("_cid").alias("a"), F.col("cid").alias("b"), F.col("_size").alias("size_a"), F.col("size").alias("size_b")))


def _rest(rows: DataFrame, percent: int) -> DataFrame:
    """All pairs that meet, can be similar and are in different components.

    In each group the members outside its leader's component are compared to all. Members whose position
    leaves no room even for the group's smallest set go first."""
    leaders = _leaders(rows).select("_token", F.col("_comp").alias("_leading"))
    least = rows.groupBy(F.col("token").alias("_token")).agg(F.min("size").alias("_least"), F.min("comp").alias("_c0"), F.max("comp").alias("_c1"))
    open_ = leaders.join(least.filter(F.col("_c0") != F.col("_c1")), "_token")
    rows = rows.join(open_, F.col("token") == F.col("_token")).filter((100 + percent) * F.col("left") >= percent * (F.col("size") + F.col("_least")))
    own = rows.filter(F.col("comp") != F.col("_leading")).select("token", "cid", "left", "size", "met", "comp")
    other = rows.select("token", F.col("cid").alias("_cid"), F.col("left").alias("_left"), F.col("size").alias("_size"),
                        F.col("met").alias("_met"), F.col("comp").alias("_comp"), (F.col("comp") == F.col("_leading")).alias("_led"))
    dealt, repeated = deal_hot(other, own, ["token"], ["_cid"], MOST)
    met = dealt.join(repeated, ["token", SALT]).filter((F.col("comp") != F.col("_comp")) & (F.col("_led") | (F.col("cid") < F.col("_cid"))) & _can_link(percent))
    return _distinct_pairs(met.select(F.col("_cid").alias("a"), F.col("cid").alias("b"), F.col("_size").alias("size_a"), F.col("size").alias("size_b")))


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Component of each class after more links."""
    if labels is None:
        return stored(components(links, "a", "b"), "labels")
    of = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    for side in ("a", "b"):
        links = links.join(of, F.col(side) == F.col("_n"), "left").withColumn(side, F.coalesce("_c", side)).drop("_n", "_c")
    merged = components(links, "a", "b").withColumnsRenamed({"node": "_n", "component": "_c"})
    kept = labels.join(merged, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_c", "component").alias("component"))
    added = merged.join(labels, F.col("_n") == F.col("node"), "left_anti").select(F.col("_n").alias("node"), F.col("_c").alias("component"))
    return stored(kept.unionByName(added), "labels")


def _grouped(docs: DataFrame, n: int, percent: int, leader_rounds: int) -> DataFrame:
    """``doc_id, text_hash, size, comp, least`` of ``doc_id, text, text_hash``: a component's key, and its smallest doc_id; both null without n-grams."""
    found, repeated = _measure(docs, n)
    order = _order(repeated)
    classes = _prefixes(docs, order, n, percent)
    meetings = _meetings(classes)
    labels = None
    for step in range(leader_rounds + 1):
        rows = _labelled(meetings, labels)
        if step == leader_rounds:
            pairs = _rest(rows, percent)
        else:
            leaders = _leaders(rows)
            if step:  # what the first leaders left
                first = leaders.select(F.col("_token").alias("_t"), F.col("_comp").alias("_led"))
                rows = rows.join(first, F.col("token") == F.col("_t")).filter(F.col("comp") != F.col("_led")).drop("_t", "_led")
                leaders = _leaders(rows)
            pairs = _against_leaders(rows, leaders, percent)
        pairs = stored(pairs, "pairs", free=True)
        if pairs.isEmpty():
            continue
        fragments = _fragments(docs, found, classes, pairs, order, n)
        labels = _joined(labels, stored(_links(pairs, fragments, percent), "links", free=True))
    least = found.groupBy("hi", "lo").agg(F.min("doc_id").alias("least"))
    by_class = _labelled(classes.select("cid", "hi", "lo"), labels).join(least, ["hi", "lo"])
    smallest = by_class.groupBy(F.col("comp").alias("_comp")).agg(F.min("least").alias("component_id"))
    named = by_class.join(smallest, F.col("comp") == F.col("_comp")).select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), "comp", "component_id")
    some = found.filter("size > 0").join(named, (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo")))
    none = F.lit(None).cast("long")
    return some.select("doc_id", "text_hash", "size", "comp", F.col("component_id").alias("least")).unionByName(
        found.filter("size = 0").select("doc_id", "text_hash", "size", none.alias("comp"), none.alias("least")))


def _own(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return columns(docs, doc_id=F.col(f"`{doc_id}`").cast("long"), text=text, text_hash=F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))


def classes_and_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT,
                           leader_rounds: int = 2) -> DataFrame:
    """``doc_id, text_hash, n_shingles, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest doc_id that links reach, own included. Null and empty texts have no
    n-grams and only themselves. Rows with one doc_id are documents of their own; a null doc_id has no
    say in the smallest, and is null where no other is reached. An empty table gives no rows. Other
    columns are not read.
    """
    rows = _grouped(_own(docs, doc_id, text), n, percent, leader_rounds)
    return rows.select("doc_id", "text_hash", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT, leader_rounds: int = 2) -> DataFrame:
    """The columns of ``docs``; of each component one row: the smallest doc_id, of equal ones the first by a hash of the text, of equal
    rows a single one.

    Rows without n-grams or with a null doc_id, which nothing is smaller than, all stay; equal rows without n-grams are one."""
    own, key = docs.columns, fresh(docs, "_key")
    named = _grouped(_own(docs, doc_id, text), n, percent, leader_rounds).filter(F.col("doc_id").isNotNull())
    first = named.filter("size > 0").groupBy("comp").agg(F.min(F.struct("doc_id", "text_hash")).alias("one")).select("one.*")
    keep = first.unionByName(named.filter("size = 0").select("doc_id", "text_hash")).select(F.col("doc_id").alias(f"{key}_d"), F.col("text_hash").alias(f"{key}_t"))
    rows = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    loose = rows.filter(F.col(f"`{doc_id}`").isNull()).select(*[F.col(f"`{c}`") for c in own])
    kept = rows.join(keep.distinct(), (F.col(f"`{doc_id}`") == F.col(f"{key}_d")) & (F.col(key) == F.col(f"{key}_t")), "left_semi")
    return kept.dropDuplicates([doc_id, key]).select(*[F.col(f"`{c}`") for c in own]).unionByName(loose)
