"""Toxicity: a small convolutional text classifier, trained in numpy, applied in tasks.

A word's embedding is the sum of hashed rows for the word and its beginnings and endings, so words
never seen still have one. Filters of several widths run over the words of the whole text; each
keeps its largest value (max pooling), and a logistic layer turns these into a score. Only words
enter a score. Scores are calibrated on sampled labelled rows kept out of training; thresholds for the
decision are set per language on all labelled rows that are neither fitted on nor held out.

The model is fitted on the driver on at most ``PER_CLASS`` labelled texts of each class, those with
the smallest hash of their id, however many there are, without texts of more than ``FIT_BYTES``. Everything else runs over all
rows: each text is scored once, and the stored scores serve both to set the thresholds and to apply them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import columns, flat_words, fresh, pieces, release, stored

#: Labelled texts of each class that the model is fitted on, at most.
PER_CLASS = 1500
#: Longer texts are not fitted on; they are scored like all others.
FIT_BYTES = 1 << 20
BUCKETS, WIDTH, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
_AROUND = b".,!?;:*$%&|<>#()\"'"
_HEADS, _TAILS = (3, 4, 5, 6, 7, 8, 9), (3, 4, 5)
ROWS = 1 + len(_HEADS) + len(_TAILS)
SCORE_LIMIT = 0.7
#: A threshold is drawn to the one above it, the limit or the common threshold, as if that had this many rows of each class.
PRIOR = 15
#: Steps of the log odds of a score, from -30 to 30, in which labelled rows are counted.
STEP = 0.05


def word_rows(word: bytes) -> list[int]:
    """Buckets of a word, its beginnings and its endings; 0 stands for none."""
    w = word.strip(_AROUND) or word
    h, n = xxhash.xxh32_intdigest, len(w)
    return ([h(w) % (BUCKETS - 1) + 1] + [h(w[:k], k) % (BUCKETS - 1) + 1 if k < n else 0 for k in _HEADS]
            + [h(w[-k:], 16 + k) % (BUCKETS - 1) + 1 if k < n else 0 for k in _TAILS])


class WordTable:
    """Buckets of distinct words, each made once; emptied when it holds ``most``."""

    def __init__(self, most: int = 150_000):
        self.most, self.row, self.rows = most, {}, np.zeros((1 << 12, ROWS), np.int32)

    def take(self, words: list[bytes]) -> np.ndarray:
        """The row of each word in ``rows``."""
        if len(self.row) > self.most:
            self.row = {}
        new = sorted(set(words).difference(self.row))
        if new:
            n = len(self.row)
            while n + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[n:n + len(new)] = [word_rows(w) for w in new]
            self.row.update(zip(new, range(n, n + len(new)), strict=True))
        return np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))


@dataclass
class Model:
    embedding: np.ndarray
    filters: dict[int, np.ndarray]  # by width: width, embedding, filter
    bias: np.ndarray
    weights: np.ndarray
    start: float
    scale: tuple[float, float] = (1.0, 0.0)

    def pooled(self, x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest value of each filter in each text, and at which word; 0 and -1 where none is above 0.

        ``x``: embeddings of all words, the texts one after the other; a filter doesn't cross texts.
        """
        docs, n = len(ends) - 1, len(x)
        best, at = np.zeros((docs, len(self.bias)), np.float32), np.full((docs, len(self.bias)), -1, np.int64)
        size = np.diff(ends)
        for k, w in enumerate(WIDTHS):
            has = np.flatnonzero(size >= w)
            if not len(has):
                continue
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            out = np.full((n, FILTERS), -np.inf, np.float32)
            out[:n - w + 1] = self.bias[cols] + sum(x[j:n - w + 1 + j] @ self.filters[w][j] for j in range(w))
            for j in range(1, w):  # the last words of a text begin no window
                out[ends[1:][size >= j] - j] = -np.inf
            top = np.maximum.reduceat(out, ends[:-1][has], axis=0)
            best[has, cols] = np.maximum(top, 0)
            if self.places:
                for d, t in zip(has, top, strict=True):
                    part = out[ends[d]:ends[d + 1]].argmax(0)
                    at[d, cols] = np.where(t > 0, part + ends[d], -1)
        return best, at

    places = False

    def logits(self, rows: np.ndarray, of: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.pooled(self.embedding[rows].sum(1)[of], ends)[0] @ self.weights + self.start

    def odds(self, z: np.ndarray) -> np.ndarray:
        """Calibrated log odds."""
        a, b = self.scale
        return np.clip(a * z + b, -30, 30)


def _fit(texts: list[list[bytes]], y: np.ndarray, epochs: int, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    table = WordTable(most=1 << 62)
    of = [table.take(t) for t in texts]
    rows = table.rows[:len(table.row)]
    # the first coordinate begins as the log odds of the class given the bucket, counted by text
    seen = np.zeros((2, BUCKETS), np.float32)
    for t, label in zip(of, y, strict=True):
        seen[int(label), np.unique(rows[t]) if len(t) else []] += 1
    odds = np.log((seen[1] + 1) / (y.sum() + 2)) - np.log((seen[0] + 1) / (len(y) - y.sum() + 2))
    embedding = rng.normal(0, 0.05, (BUCKETS, WIDTH)).astype(np.float32)
    embedding[:, 0] = odds * 0.3
    embedding[0] = 0
    filters = {w: rng.normal(0, 0.3, (w, WIDTH, FILTERS)).astype(np.float32) for w in WIDTHS}
    for w in WIDTHS:
        filters[w][:, 0] = np.linspace(1.0, 0.2, FILTERS) / w
    m = Model(embedding, filters, np.zeros(len(WIDTHS) * FILTERS, np.float32), np.full(len(WIDTHS) * FILTERS, 0.1, np.float32), -1.0)
    m.places = True
    past = {k: 1e-2 for k in ("e", "w", "b", "s", *WIDTHS)}
    past["e"] = np.full(BUCKETS, 1e-2, np.float32)

    def step(name, value, grad, rate):
        past[name] = past[name] + grad * grad
        return value - rate * grad / np.sqrt(past[name])

    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(y)), max(1, len(y) // 32)):
            words = np.concatenate([of[i] for i in batch])
            ends = np.r_[0, np.cumsum([len(of[i]) for i in batch])]
            x = m.embedding[rows[words]].sum(1)
            f, at = m.pooled(x, ends)
            z = f @ m.weights + m.start
            g = (1 / (1 + np.exp(-z)) - y[batch]) / len(batch)
            flow = np.where(at >= 0, g[:, None] * m.weights, 0)
            moved: dict[int, np.ndarray] = {}
            for k, w in enumerate(WIDTHS):
                grad = np.zeros_like(m.filters[w])
                for d, c in zip(*np.nonzero(flow[:, k * FILTERS:(k + 1) * FILTERS]), strict=True):
                    v, p = flow[d, k * FILTERS + c], at[d, k * FILTERS + c]
                    grad[:, :, c] += v * x[p:p + w]
                    for j in range(w):
                        moved[p + j] = moved.get(p + j, 0) + v * m.filters[w][j, :, c]
                m.filters[w] = step(w, m.filters[w], grad, 0.05)
            m.bias = step("b", m.bias, flow.sum(0), 0.02)
            m.weights = step("w", m.weights, g @ f, 0.05)
            m.start = float(step("s", m.start, g.sum(), 0.05))
            if moved:
                hit = rows[words[list(moved)]]
                ids, back = np.unique(hit.ravel(), return_inverse=True)
                delta = np.zeros((len(ids), WIDTH), np.float32)
                np.add.at(delta, back, np.repeat(np.array(list(moved.values()), np.float32), ROWS, axis=0))
                delta[ids == 0] = 0
                past["e"][ids] += (delta * delta).mean(1)
                m.embedding[ids] -= 0.05 * delta / np.sqrt(past["e"][ids])[:, None]
    m.places = False
    return m


def _logits(m: Model, texts: list[list[bytes]]) -> np.ndarray:
    table = WordTable(most=1 << 62)
    out = []
    for a in range(0, len(texts), 64):
        some = texts[a:a + 64]
        of = table.take([w for t in some for w in t])
        out.append(m.logits(table.rows[:len(table.row)], of, np.r_[0, np.cumsum([len(t) for t in some])]))
    return np.concatenate(out) if out else np.empty(0)


def _calibrate(m: Model, z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
    """Slope and start of the logistic curve (Newton steps, each class with its share of all labelled rows)."""
    a, b = 1.0, 0.0
    y = np.where(y > 0, 1 - 1 / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([(weight * (p - y) * z).sum(), (weight * (p - y)).sum()]) + np.array([1e-3 * (a - 1), 0])
        s = weight * p * (1 - p)
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a - np.clip(d[0], -1, 1), b - np.clip(d[1], -2, 2)
        if abs(d).max() < 1e-6:
            break
    m.scale = (max(float(a), 1e-3), float(b))


def _best_threshold(odds: np.ndarray, bad: np.ndarray, good: np.ndarray) -> float:
    """Of ascending log odds with weights of both classes, the threshold with the best F1: halfway from the last place that is
    rejected to the next lower one, as a score from 0.2 to 0.9."""
    hit, miss = np.cumsum(bad[::-1]), np.cumsum(good[::-1])
    k = int(np.argmax(2 * hit / (hit + miss + bad.sum())))
    p = 1 / (1 + np.exp(-odds[::-1]))
    below = p[k + 1] if k + 1 < len(p) else 0.0
    return float(np.clip((p[k] + below) / 2, 0.2, 0.9))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _marks(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """``_d, _y``: labelled ids that may be learnt from, each once; the higher label counts."""
    marks = columns(labels, _d=F.col(f"`{doc_id}`").cast("long"), _y=F.col(f"`{label}`").cast("int")).filter("_d is not null and _y in (0, 1)")
    return marks.groupBy("_d").agg(F.max("_y").alias("_y")).filter(~held_out(F.col("_d")))


def _read(rows: DataFrame) -> list[tuple[int, int, list[bytes]]]:
    """``d, _y`` and the words of ``text``, of a bounded sample; texts come one by one, and a word that many texts hold is held once."""
    known: dict[bytes, bytes] = {}
    return [(d, y, [known.setdefault(w, w) for w in text.encode().lower().split()]) for d, y, text in rows.toLocalIterator()]


def fit(docs: DataFrame, marks: DataFrame, *, doc_id: str = "doc_id", text: str = "text", per_class: int = PER_CLASS, epochs: int = 6,
        seed: int = 1) -> tuple[Model, list[int], dict[int, int]]:
    """A calibrated model, the ids it was fitted on, and the labelled rows of each class; ``marks`` as :func:`_marks` gives them.

    Of texts with one id the first by hash is taken. Without both classes every text scores 0.5.
    """
    counts = {r["_y"]: r["count"] for r in marks.groupBy("_y").count().collect()}
    chosen = None
    for y in (0, 1):  # the smallest hashes of each class, and so no more than 2 * per_class rows
        some = marks.filter(F.col("_y") == y).orderBy(F.xxhash64("_d"), "_d").limit(per_class)
        chosen = some if chosen is None else chosen.unionByName(some)
    rows = columns(docs, d=F.col(f"`{doc_id}`").cast("long"), text=F.coalesce(F.col(f"`{text}`"), F.lit(""))).filter(F.octet_length("text") <= FIT_BYTES)
    met = rows.join(F.broadcast(chosen), F.col("d") == F.col("_d"))
    one = met.groupBy("d", "_y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")).select("d", "_y", "one.text")
    got = sorted(_read(one), key=lambda r: xxhash.xxh32_intdigest(str(r[0])))
    y = np.array([label for _, label, _ in got], np.float64)
    words = [w for _, _, w in got]
    aside = np.arange(len(got)) % 4 == 3
    if any(y[aside == s].sum() in (0, (aside == s).sum()) for s in (False, True)):
        z = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        return Model(np.zeros((BUCKETS, WIDTH), np.float32), {w: np.zeros((w, WIDTH, FILTERS), np.float32) for w in WIDTHS}, z, z, 0.0), [], {0: 0, 1: 0}
    m = _fit([w for w, s in zip(words, aside, strict=True) if not s], y[~aside], epochs, seed)
    z, ya = _logits(m, [w for w, s in zip(words, aside, strict=True) if s]), y[aside]
    share = np.array([counts[0] / (1 - y).sum(), counts[1] / y.sum()])
    _calibrate(m, z, ya, (share / share.min())[ya.astype(int)])
    return m, [d for (d, _, _), out in zip(got, aside, strict=True) if not out], counts


def add_odds(docs: DataFrame, model: Model, name: str, *, text: str = "text", keep_text: bool = True) -> DataFrame:
    """The columns of ``docs``, without the text unless it is kept, and ``name``, the log odds of each whole text; a text without words
    has those of no filter firing."""
    place = docs.columns.index(text)
    kept = [i for i in range(len(docs.columns)) if keep_text or i != place]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, table = shared.value, WordTable()
        for batch in batches:
            for piece in pieces(batch, text, 1 << 20):
                words, ends = flat_words(piece.column(place))
                known = table.take(words)
                used, of = np.unique(known, return_inverse=True)
                odds = m.odds(m.logits(table.rows[used], of, ends))
                yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in kept), pa.array(odds, pa.float64())], [*(piece.schema.names[i] for i in kept), name])
            release()

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(run, StructType([*(docs.schema.fields[i] for i in kept), StructField(name, DoubleType())]))


def thresholds(rows: DataFrame, counts: dict[int, int]) -> tuple[float, DataFrame]:
    """How far to move all log odds, so that the common threshold is ``SCORE_LIMIT``, and ``lang, threshold`` of each language that has
    labelled rows of both classes.

    ``rows``: ``d, _y, lang, odds`` of labelled rows; of rows with one id the first counts. They are counted in steps of the odds, weighed
    so that the classes are as frequent as in ``counts``. The common counts, some hundred numbers, come to the driver; languages are
    settled in tasks, one each. Thresholds are drawn to the limit, and to the common one, the more the fewer rows of either class there are.
    """
    each = rows.groupBy("d", "_y").agg(F.min(F.struct("lang", "odds")).alias("one")).select("_y", "one.lang", "one.odds")
    places = stored(each.groupBy("lang", "_y", F.round(F.col("odds") / STEP).cast("int").alias("place")).agg(F.count(F.lit(1)).alias("n")), "places")
    whole = places.groupBy("_y", "place").agg(F.sum("n").alias("n")).collect()
    total = [sum(r.n for r in whole if r["_y"] == k) for k in (0, 1)]
    share = [counts.get(k, 0) / total[k] if total[k] else 0.0 for k in (0, 1)]
    move = 0.0
    if min(total):
        at = sorted({r.place for r in whole})
        n = np.zeros((2, len(at)))
        for r in whole:
            n[r["_y"], at.index(r.place)] += r.n * share[r["_y"]]
        best = (min(total) * _best_threshold(np.array(at) * STEP, n[1], n[0]) + PRIOR * SCORE_LIMIT) / (min(total) + PRIOR)
        move = float(np.log(SCORE_LIMIT / (1 - SCORE_LIMIT)) - np.log(best / (1 - best)))

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        some = min(part.n[part._y == k].sum() for k in (0, 1))
        if not some:
            return pd.DataFrame({"lang": pd.Series([], dtype=object), "threshold": pd.Series([], dtype=float)})
        at = np.sort(part.place.unique())
        n = np.zeros((2, len(at)))
        np.add.at(n, (part._y.to_numpy(), np.searchsorted(at, part.place)), part.n * np.array(share)[part._y])
        own = _best_threshold(at * STEP + move, n[1], n[0])
        return pd.DataFrame({"lang": pd.Series([part.lang.iloc[0]], dtype=object), "threshold": [(some * own + PRIOR * SCORE_LIMIT) / (some + PRIOR)]})

    return move, stored(places.filter("lang is not null").groupBy("lang").applyInPandas(settle, "lang string, threshold double"), "thresholds")


RESULTS = ("score", "predicted", "threshold", "rejected")


def classify(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic", keep_text: bool = True,
             **options) -> DataFrame:
    """The columns of ``docs``, without the text unless it is kept, with ``score`` (0 to 1), ``predicted`` (1 if 0.7 or more), ``threshold`` (of
    the language) and ``rejected``.

    The model is fitted on labelled rows whose ``crc32(doc_id) % 3`` is not 1. Whole texts are scored; null and empty ones have no
    words. A null language, and one without labelled rows of both classes, takes the common threshold. Repeated rows are scored
    each; labels without id or label are left out. An empty table gives no rows; without labels of both classes every score is 0.5. Columns
    named like a result are replaced.
    """
    rows = docs.drop(*[c for c in docs.columns if c.lower() in RESULTS])
    own = [c for c in rows.columns if keep_text or c != text]
    marks = stored(_marks(labels, doc_id, label), "marks")
    model, fitted, counts = fit(rows, marks, doc_id=doc_id, text=text, **options)
    odds = fresh(rows, "_odds")
    scored = stored(add_odds(rows, model, odds, text=text, keep_text=keep_text), "scored")
    rest = marks.join(F.broadcast(docs.sparkSession.createDataFrame([(d,) for d in fitted], "_f long")), F.col("_d") == F.col("_f"), "left_anti")  # a bounded sample
    labelled = columns(scored, d=F.col(f"`{doc_id}`").cast("long"), lang=F.col(f"`{lang}`").cast("string"), odds=odds).join(rest, F.col("d") == F.col("_d"))
    move, by_lang = thresholds(labelled.select("d", "_y", "lang", "odds"), counts)
    limits = by_lang.select(F.col("lang").alias(f"{odds}_lang"), F.col("threshold").alias(f"{odds}_limit"))
    met = scored.join(limits, F.col(f"`{lang}`") == F.col(f"{odds}_lang"), "left")
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col(odds) + F.lit(move)))))
    met = met.withColumn(odds, score)
    limit = F.coalesce(F.col(f"{odds}_limit"), F.lit(SCORE_LIMIT))
    return met.select(*[F.col(f"`{c}`") for c in own], F.col(odds).alias("score"), (F.col(odds) >= SCORE_LIMIT).cast("int").alias("predicted"),
                      limit.alias("threshold"), (F.col(odds) >= limit).alias("rejected"))


def without_toxic(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """The rows of ``docs``, unchanged, that the classifier doesn't reject. Rows are judged one by one, as :func:`classify` does."""
    own = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)])
    at = {n: f"c{own.index(c)}" for n, c in (("doc_id", doc_id), ("text", text), ("lang", lang))}
    marks = columns(labels, **{at["doc_id"]: F.col("doc_id"), "toxic": F.col("toxic")})
    kept = classify(rows, marks, **at, **options).filter(~F.col("rejected"))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(own)])
