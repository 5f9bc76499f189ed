"""Mixing sources to target weights by systematic sampling.

A source's target is its weight's share of all words, held at ``most`` times its own words; what a
source can't use goes to the others by weight until none is above its limit. Each of its documents
is then expected ``target / source size`` times. Documents are lined up by size; a running sum of
expected copies starts at one random offset per source, and a document is taken once for each
integer that the sum crosses in it. So no document is taken more than ``most`` times, and as
neighbours in the line have nearly the same size, the words taken come near the target.

As the expectation is the same for all of a source's documents, the running sum is the document's
position times it. Positions are counted in two steps, by size and by a hash bucket within a size:
totals per step are summed before they are shuffled, and no window holds a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilespark.llm.common import BLANK

WEIGHTS = (5, 2, 1)
MOST = 3


def n_words(text: Column) -> Column:
    """Number of words; null has none."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{BLANK}|{BLANK}$", "")
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, BLANK))).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """``source, source_size`` with ``target``. One row per source, so these few rows are ranked together.

    Weights go to the sources in the order of their code points, null last, and repeat. With limits
    ``most * size``, the result of resharing is ``min(limit, level * weight)`` for one level: taking
    sources by limit per weight, the level is what is left for those that stay below their limit.
    """
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (at % len(weights) + 1).cast("int")))
    w = w.withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    upto, every = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy()
    total = F.sum("source_size").over(every).cast("double")
    w = w.withColumn("_full", F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    w = w.withColumn("_open", F.sum("_w").over(every) - F.sum("_w").over(upto) + F.col("_w")).withColumn("_total", total)
    level = (F.col("_total") - F.col("_full")) / F.col("_open")
    # the first source, in this order, that the level reaches before its limit sets the level for all after it
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = w.withColumn("_level", F.first(F.when(level * F.col("_w") <= F.col("_cap"), level), ignorenulls=True).over(whole))
    return w.select("source", "source_size", F.least("_cap", F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """One number from 0 to 1 per source, the same in each run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), source), F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[float] = WEIGHTS, most: float = MOST, seed: int = 7) -> DataFrame:
    """The columns of ``docs`` and ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (= copies * size).

    Null text has size 0; a null source is a source, the last. Documents of a source without words are
    not taken. Repeated rows are documents of their own; rows alike in source, size and id are lined up by
    their text. An empty table gives no rows. Columns of ``docs`` named like a result are replaced.
    """
    results = ("size", "source_size", "target", "copies", "taken")
    own = [c for c in docs.columns if c.lower() not in results]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), F.col(f"`{source}`").alias("_s"), F.col(f"`{doc_id}`").alias("_d"),
                       n_words(F.col(f"`{text}`")).alias("_n"), F.xxhash64(F.col(f"`{text}`")).alias("_h"))
    return _placed(rows, weights, most, seed).select("_row.*", F.col("_n").alias("size"), "source_size", "target", "copies", "taken")


def _placed(rows: DataFrame, weights: Sequence[float], most: float, seed: int) -> DataFrame:
    """Adds source size, target, copies and words taken to rows of ``_s`` source, ``_d`` id, ``_n`` size, ``_h`` hash."""
    rows = rows.withColumn("_b", F.substring(F.md5(F.coalesce(F.col("_d").cast("string"), F.lit(""))), 1, 3))
    parts = rows.groupBy("_s", "_n", "_b").agg(F.count(F.lit(1)).alias("_c"))
    sizes = parts.groupBy("_s", "_n").agg(F.sum("_c").alias("_c"))
    earlier = (Window.unboundedPreceding, -1)
    nothing = F.lit(0).cast("long")
    by_size = sizes.select(F.col("_s").alias("_s1"), F.col("_n").alias("_n1"), F.coalesce(
        F.sum("_c").over(Window.partitionBy("_s").orderBy("_n").rowsBetween(*earlier)), nothing).alias("_before_size"))
    by_part = parts.select(F.col("_s").alias("_s2"), F.col("_n").alias("_n2"), F.col("_b").alias("_b2"), F.coalesce(
        F.sum("_c").over(Window.partitionBy("_s", "_n").orderBy("_b").rowsBetween(*earlier)), nothing).alias("_before_part"))
    totals = sizes.groupBy(F.col("_s").alias("source")).agg(F.sum(F.col("_n") * F.col("_c")).alias("source_size"))
    targets = source_targets(totals, weights, most).withColumn(
        "_rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("_u", offset(F.col("source"), seed))
    starts = by_part.join(by_size, F.col("_s1").eqNullSafe(F.col("_s2")) & (F.col("_n1") == F.col("_n2")))
    starts = starts.join(targets, F.col("source").eqNullSafe(F.col("_s2"))).select(
        "_s2", "_n2", "_b2", "source_size", "target", "_rate", "_u", (F.col("_before_size") + F.col("_before_part")).alias("_before"))
    joined = rows.join(starts, F.col("_s").eqNullSafe(F.col("_s2")) & (F.col("_n") == F.col("_n2")) & (F.col("_b") == F.col("_b2")))
    inside = Window.partitionBy("_s", "_n", "_b").orderBy(F.col("_d").asc_nulls_last(), "_h")
    at = F.col("_before") + F.row_number().over(inside)
    crossed = F.floor(at * F.col("_rate") + F.col("_u")) - F.floor((at - 1) * F.col("_rate") + F.col("_u"))
    return joined.withColumn("copies", crossed.cast("long")).withColumn("taken", F.col("copies") * F.col("_n"))


def take(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: the columns of ``docs``, each row as often as it is taken."""
    own = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)])
    named = {k: f"c{own.index(options.pop(k, k))}" for k in ("doc_id", "text", "source")}
    mixed = mix(rows, **named, **options).filter(F.col("copies") > 0)
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(own)])


def sizes_only(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source",
               weights: Sequence[float] = WEIGHTS, most: float = MOST, seed: int = 7) -> DataFrame:
    """As :func:`mix`, but only ids and figures: texts are read once and never shuffled."""
    from tilespark.llm.common import stored

    rows = docs.select(F.col(f"`{source}`").alias("_s"), F.col(f"`{doc_id}`").alias("_d"), n_words(F.col(f"`{text}`")).alias("_n"),
                       F.xxhash64(F.col(f"`{text}`")).alias("_h"))
    return _placed(stored(rows, "sizes"), weights, most, seed).select(
        F.col("_d").alias("doc_id"), F.col("_n").alias("size"), "source_size", "target", "copies", "taken")
