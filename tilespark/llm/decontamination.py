"""Benchmark decontamination: one Aho-Corasick automaton over the test items, each text scanned once.

Items are lower-cased (A-Z) and cut into words; every run of ten words of an item is a window, and
an item of fewer words is one window. The automaton's alphabet is the items' words, so a text is
scanned as word numbers, and a match says directly which words it covers. Word positions lead back
to offsets in the original text, as normalising replaces bytes one by one.

The automaton holds the short items and every fifth run of five words of the others: any window holds such a run whole.
Where one is found, the few windows around it are looked up among the items' windows, by a hash and then word by word. So the
automaton has about as many nodes as the items have words. Workers read the items from a stored table; the driver holds none.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import add_by_batch, columns, shared_path, texts
from tilespark.sources.storage import open_filesystem

WINDOW = 10

#: Bytes of a word stay (A-Z lower-cased), all others become a space; bytes of other alphabets stay.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

ADDED = ("n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, contaminated boolean, "
         "spans array<struct<first:long,last:long>>")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


def _window_hashes(numbers: np.ndarray, window: int, seed: int) -> np.ndarray:
    """A hash of each run of ``window`` numbers."""
    out = np.zeros(max(0, len(numbers) - window + 1), np.uint64)
    wide = (numbers.astype(np.uint64) + np.uint64(seed)) * np.uint64(0xBF58476D1CE4E5B9)
    wide ^= wide >> np.uint64(29)
    for k in range(window):
        out = out * np.uint64(0x9E3779B97F4A7C15) + wide[k:len(numbers) - window + 1 + k]
    return out ^ (out >> np.uint64(31))


class Matcher:
    """The automaton of some items (id as string, text), and their windows by hash."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        import ahocorasick

        self.window, self.run = window, window // 2
        self.number: dict[bytes, int] = {}
        patterns: dict[tuple[int, ...], set[str] | None] = {}
        runs: set[tuple[int, ...]] = set()
        parts, starts, owners, at = [np.empty(0, np.int32)], [np.empty(0, np.int64)], [np.empty(0, np.int32)], 0
        self.names: list[str] = []
        for item, text in items:
            w = [self.number.setdefault(x, len(self.number) + 1) for x in words_of(text)]
            if not w:
                continue
            if len(w) < window:
                patterns.setdefault(tuple(w), set()).add(item)
                continue
            runs.update(tuple(w[i:i + self.run]) for i in range(0, len(w) - self.run + 1, self.run))
            parts.append(np.array(w, np.int32))
            starts.append(np.arange(at, at + len(w) - window + 1))
            owners.append(np.full(len(w) - window + 1, len(self.names), np.int32))
            self.names.append(item)
            at += len(w)
        self.words, start, owner = np.concatenate(parts), np.concatenate(starts), np.concatenate(owners)
        self.seed = 0
        while len(start):  # until no two different windows share a hash
            hashes = _window_hashes(self.words, window, self.seed)[start]
            by = np.argsort(hashes, kind="stable")
            ordered, first = hashes[by], start[by]
            same = np.flatnonzero(ordered[1:] == ordered[:-1])
            spread = np.arange(window)
            if all(np.array_equal(self.words[first[some][:, None] + spread], self.words[first[some + 1][:, None] + spread]) for some in np.array_split(same, len(same) // 100_000 + 1)):
                break
            self.seed += 1
        if len(start):
            edge = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
            self.hashes, self.first, self.cuts, self.owner = ordered[edge], first[edge], np.r_[edge, len(ordered)], owner[by]
        else:
            self.hashes = np.empty(0, np.uint64)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for p in patterns.keys() | runs:
            self.automaton.add_word(p, (len(p), tuple(patterns.get(p, ())), p in runs))
        self.some = bool(patterns or runs)
        if self.some:
            self.automaton.make_automaton()
        self.least = min([len(p) for p in patterns] + [window] * bool(runs), default=0)

    def find(self, words: list[bytes]) -> list[tuple[int, int, tuple[str, ...]]]:
        """First and last word of each match, and the items it belongs to."""
        if not self.some or len(words) < self.least:
            return []
        known = self.number.get
        numbers = tuple(known(w, 0) for w in words)
        out, possible = [], set()
        for end, (n, ids, is_run) in self.automaton.iter(numbers):
            if ids:
                out.append((end - n + 1, end, ids))
            if is_run:  # windows that hold this run
                possible.update(range(max(0, end - self.window + 1), min(end - n + 1, len(words) - self.window) + 1))
        if possible:
            array, start = np.array(numbers, np.int32), np.array(sorted(possible))
            low, high = start[0], start[-1] + self.window
            found = _window_hashes(array[low:high], self.window, self.seed)[start - low]
            at = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
            for s, k in zip(start[self.hashes[at] == found].tolist(), at[self.hashes[at] == found].tolist(), strict=True):
                if np.array_equal(array[s:s + self.window], self.words[self.first[k]:self.first[k] + self.window]):
                    out.append((s, s + self.window - 1, tuple(self.names[o] for o in self.owner[self.cuts[k]:self.cuts[k + 1]].tolist())))
        return out


_MATCHERS: dict[str, Matcher] = {}


def matcher(path: str) -> Matcher:
    """The automaton of a stored table of items, one for each worker process."""
    if path not in _MATCHERS:
        import pyarrow.parquet as pq

        system, place = open_filesystem(path)
        items = pq.read_table(place, filesystem=system, columns=["item", "text"])
        _MATCHERS.clear()
        _MATCHERS[path] = Matcher(list(zip(items.column("item").to_pylist(), texts(items.column("text").combine_chunks()), strict=True)))
    return _MATCHERS[path]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def char_spans(text: bytes, ranges: list[tuple[int, int]]) -> list[dict]:
    """Ranges of words as offsets of characters in the original text (last is past the end)."""
    inside = np.frombuffer(text.translate(NORMAL), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    chars = np.r_[0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)]
    return [{"first": int(chars[edge[2 * a]]), "last": int(chars[edge[2 * b + 1]])} for a, b in ranges]


def stored_items(benchmark: DataFrame, item_id: str, text: str) -> str:
    """Where the distinct items are stored, for all workers to read."""
    items = columns(benchmark, item=F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")), text=F.coalesce(F.col(f"`{text}`"), F.lit("")))
    path = shared_path(benchmark.sparkSession, "items")
    items.distinct().write.parquet(path)
    return path


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The columns of ``docs`` and, for each row: number of words, of words inside matches and of items that
    match, the items (sorted as strings), the SHA-256 of their comma-joined ids, whether there is any, and
    the matches as merged offsets in the original text.

    Null and empty texts have no words, no hit, and the digest of the empty string. Items without words
    match nothing; repeated items count once; a null item id counts as the empty string. Without items,
    nothing is contaminated. Repeated rows are marked each; an empty table gives no rows. A column of ``docs`` named like a result
    is replaced by it. A worker holds the items' words, their windows and the automaton: some 150 bytes for each word of an item.
    """
    from pyspark.sql.types import StructType

    results = [f.name for f in StructType.fromDDL(ADDED).fields]
    rows = docs.drop(*[c for c in docs.columns if c.lower() in results])
    place = rows.columns.index(text)
    path = stored_items(benchmark, item_id, item_text)

    def mark(piece: pa.RecordBatch) -> dict:
        of, out = matcher(path), {n: [] for n in results}
        for t in texts(piece.column(place)):
            words = words_of(t)
            hits = of.find(words)
            ranges = merged([(a, b) for a, b, _ in hits])
            ids = sorted({x for _, _, y in hits for x in y})
            row = (len(words), sum(b - a + 1 for a, b in ranges), len(ids), ids,
                   hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hits), char_spans(t, ranges) if ranges else [])
            for n, v in zip(results, row, strict=True):
                out[n].append(v)
        return out

    return add_by_batch(rows, ADDED, mark, text)


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, that share no window with an item."""
    own = docs.columns
    kept = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)])
    marked = mark_contaminated(kept, benchmark, text=f"c{own.index(text)}").filter(~F.col("contaminated"))
    return marked.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)])
