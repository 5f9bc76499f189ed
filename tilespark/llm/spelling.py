"""Spelling variants: words that differ by one letter, grouped under the form that is much more frequent.

Pivotal grams. Bigrams have one global order, rare ones first. A word's prefix is its three rarest bigrams (and
further occurrences of the third); two of them that don't overlap, the rarest such pair by dynamic programming, are
its pivots. One edit spoils at most one pivot, so of two near words the one whose prefix ends earlier in the order
has a pivot that is in the other's prefix. The edit lies to the left or to the right of that bigram, and in one half
of that side: so the whole of the other side, the other half, and the side's length are as in the prefix's word.
Pivots are joined to prefixes on all that, which leaves few candidates; these are verified by their edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import columns, pieces, stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LETTERS = 6
LEAST_TIMES = 5
SPOILT = 199
RATIO = 5
Q = 2
EDITS = 1
PREFIX = Q * EDITS + 1


def respelt(doc_id: int | None, run: str, every: int = SPOILT) -> str:
    """The run, or one in ``every`` of a document's runs without one letter, by a checksum of document and run."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    at = h % len(run)
    return run if h % every else run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES,
                every: int = SPOILT) -> DataFrame:
    """``word, n``: words of at least ``least_letters`` that occur at least ``least_times`` in all texts; stored.

    Words are runs of the letters A-Z, a-z and those of Latin-1 from À on, A-Z lower-cased, after :func:`respelt`. Null
    and empty texts have none; a null id counts as an empty one; repeated rows count again. Other columns are not read.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter[str] = Counter()
            for piece in pieces(batch, "text"):
                for d, t in zip(piece.column("doc_id").to_pylist(), piece.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    if not t:
                        continue
                    seed = zlib.crc32(b":" if d is None else b"%d:" % d)
                    for run, n in Counter(RUN.findall(t.lower().decode("utf-8"))).items():  # bytes: only A-Z change
                        if len(run) < least_letters:
                            continue
                        h = zlib.crc32(run.encode(), seed)
                        if h % every == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1:]
                            if len(run) < least_letters:
                                continue
                        total[run] += n
            words = list(total)
            for a in range(0, len(words), 100_000):
                some = words[a:a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([total[w] for w in some], pa.int64())], ["word", "n"])

    rows = columns(docs, doc_id=F.col(f"`{doc_id}`").cast("long"), text=text)
    found = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(found.filter(F.col("n") >= least_times), "words")


def gram_order(words: DataFrame) -> dict[str, int]:
    """Words that hold a bigram, for each bigram. The letters of words are 26 and 64, so there are at most 8,100."""
    at = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(Q)))))
    return {r.gram: r.n for r in words.select(at.alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}


def best_pivots(places: Sequence[int], costs: Sequence[int], count: int = EDITS + 1) -> list[int]:
    """Indexes of ``count`` of the places (ascending), no two less than ``Q`` apart, of the least total cost; the first such
    in a tie. Dynamic programming over places: the best choice of j among the first i."""
    best: list[list[tuple[int, list[int]] | None]] = [[(0, [])] + [None] * count]
    for i, p in enumerate(places):
        row = list(best[-1])
        free = next((k for k in range(i, 0, -1) if places[k - 1] <= p - Q), 0)  # places before this one that it doesn't overlap
        for j in range(1, count + 1):
            before = best[free][j - 1]
            if before is not None and (row[j] is None or before[0] + costs[i] < row[j][0]):
                row[j] = (before[0] + costs[i], [*before[1], i])
        best.append(row)
    return best[-1][count][1]


def prefix_and_pivots(word: str, times: dict[str, int]) -> tuple[list[int], list[int], tuple[int, str]]:
    """Places of the prefix's bigrams and of the pivots among them, and the last bigram in the global order."""
    grams = [(times[word[i:i + Q]], word[i:i + Q], i) for i in range(len(word) - Q + 1)]
    last = sorted(grams)[PREFIX - 1][:2]
    prefix = [g for g in grams if g[:2] <= last]
    chosen = best_pivots([g[2] for g in prefix], [g[0] for g in prefix])
    return [g[2] for g in prefix], [prefix[i][2] for i in chosen], last


def side_keys(word: str, place: int, lengths: Sequence[int]) -> Iterator[str]:
    """What stays if the edit is in one half of one side of the bigram at ``place``, for a side that has one of ``lengths`` more
    letters in the other word. The names hold the side, its length there and the place counted from the other end."""
    for side, w, p in (("R", word, place), ("L", word[::-1], len(word) - place - Q)):
        rest = len(w) - p - Q
        for more in lengths:
            size = rest + more
            half = size // 2
            if size < 0:
                continue
            kept = w[:p + Q]
            if half <= rest:
                yield f"{side}{p},{size}<{kept}{w[p + Q:p + Q + half]}"
            if size - half <= rest:
                yield f"{side}{p},{size}>{kept}{w[len(w) - (size - half):]}"


def near_words(words: DataFrame) -> DataFrame:
    """``a, b, n_a, n_b``, once for each two words at an edit distance of 1, ``a`` the smaller. ``words``: ``word`` (of
    at least five letters, each once) and ``n``."""
    times = gram_order(words)
    order = {g: i for i, (_, g) in enumerate(sorted((n, g) for g, n in times.items()))}

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 5_000):
                part = batch.slice(at, 5_000)
                keys, which, lasts, pivot = [], [], [], []
                for i, w in enumerate(part.column("word").to_pylist()):
                    prefix, pivots, last = prefix_and_pivots(w, times)
                    rank = order[last[1]]
                    for is_pivot, places, lengths in ((True, pivots, (-1, 0, 1)), (False, prefix, (0,))):
                        made = [k for p in places for k in side_keys(w, p, lengths)]
                        keys += made
                        which += [i] * len(made)
                        lasts += [rank] * len(made)
                        pivot += [is_pivot] * len(made)
                take = np.array(which, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), part.column("word").take(pa.array(take)), part.column("n").take(pa.array(take)),
                                                  pa.array(lasts, pa.int32()), pa.array(pivot, pa.bool_())], ["key", "word", "n", "last", "pivot"])

    spark = words.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = stored(words.select("word", "n").repartition(tasks, "word").mapInArrow(index, "key string, word string, n long, last int, pivot boolean")
                  .withColumn("key", F.xxhash64("key")), "grams")
    s = rows.filter("pivot").select("key", F.col("word").alias("s"), F.col("n").alias("n_s"), F.col("last").alias("last_s"))
    r = rows.filter("not pivot").select(F.col("key").alias("_key"), F.col("word").alias("r"), F.col("n").alias("n_r"), F.col("last").alias("last_r"))
    met = s.join(r, (F.col("key") == F.col("_key")) & (F.col("last_s") <= F.col("last_r")) & (F.col("s") != F.col("r"))
                 & (F.abs(F.char_length("s") - F.char_length("r")) <= EDITS))
    near = met.filter(F.levenshtein("s", "r", EDITS) == EDITS)
    first = F.col("s") < F.col("r")
    return near.select(F.least("s", "r").alias("a"), F.greatest("s", "r").alias("b"), F.when(first, F.col("n_s")).otherwise(F.col("n_r")).alias("n_a"),
                       F.when(first, F.col("n_r")).otherwise(F.col("n_s")).alias("n_b")).distinct()


def with_roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: the last word that forms lead to, by doubling. A form is at least ``RATIO`` times
    as frequent, so chains are short and have no circles."""
    links = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        to = links.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        further = stored(links.join(to, F.col("root") == F.col("_word"), "left").select(
            "word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "roots")
        links = further.select("word", "root")
        if further.filter("moved").isEmpty():
            return links


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word.

    ``form``: of the words at a distance of 1 the most frequent (the first by code points in a tie), if it is at least
    ``ratio`` times as frequent as the word; else null. ``root``: where forms end, the word itself without one.
    No words: no rows.
    """
    pairs = stored(near_words(words), "near")
    both = pairs.select(F.col("a").alias("_word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(
        pairs.select(F.col("b").alias("_word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = both.groupBy("_word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other"))).alias("best"))
    found = words.join(best, F.col("word") == F.col("_word"), "left").withColumn("_many", -F.col("best.m") >= ratio * F.col("n"))
    found = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("_many"), F.col("best.other")).alias("form"),
                                F.when(F.col("_many"), -F.col("best.m")).alias("form_n")), "variants")
    roots = with_roots(found.filter(F.col("form").isNotNull())).select(F.col("word").alias("_word"), "root")
    return found.join(roots, F.col("word") == F.col("_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
