"""Ranks, running totals and runs that no single task has to hold.

A window over a key sends all of a key's rows to one task. Here a key's rows are first cut into
order-preserving buckets (a value range, a level, an hour); totals are taken per bucket with
map-side combine, carried forward over the few bucket rows, and the exact position inside a bucket
is added back. A key that owns a third of all rows is then spread over its buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKET, _BEFORE = "_bucket", "_before"
#: Values whose runs one window finds.
RUN_BLOCK = 1024


def _carried(df: DataFrame, keys: Sequence[str], total: Column) -> DataFrame:
    per_bucket = df.groupBy(*keys, _BUCKET).agg(total.alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(per_bucket.schema["_total"].dataType)
    return per_bucket.select(*keys, _BUCKET, F.coalesce(F.sum("_total").over(earlier), zero).alias(_BEFORE))


def _with_carry(df: DataFrame, keys: Sequence[str], total: Column) -> DataFrame:
    before = _carried(df, keys, total)
    on = [df[k].eqNullSafe(before[k]) for k in (*keys, _BUCKET)]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return df.join(before, condition).select(df["*"], before[_BEFORE])


def ranked_sort(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str | Column], name: str) -> DataFrame:
    """Row number per key in ``order``; ``bucket`` must not decrease along that order."""
    bucketed = df.withColumn(_BUCKET, bucket)
    joined = _with_carry(bucketed, keys, F.count(F.lit(1)))
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(*order)
    return joined.withColumn(name, F.col(_BEFORE) + F.row_number().over(inside)).drop(_BUCKET, _BEFORE)


def running_total(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str | Column], value: Column, name: str
) -> DataFrame:
    """Running sum per key in ``order``; ``bucket`` must not decrease along that order."""
    bucketed = df.withColumn(_BUCKET, bucket).withColumn("_value", value)
    joined = _with_carry(bucketed, keys, F.sum("_value"))
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(name, F.col(_BEFORE) + F.sum("_value").over(inside)).drop(_BUCKET, _BEFORE, "_value")


def runs(rows: DataFrame, keys: Sequence[str], at: str, block: int = RUN_BLOCK) -> DataFrame:
    """``keys, first, last``: runs of consecutive values of ``at`` per key, each value counted once.

    Runs are found per block of ``block`` values. Only those that touch their block's border go on to a second window, at most two a
    block, where runs that follow one another are joined; so a key's full row of 2^z values is 2^z / block rows there.
    """
    keys = list(keys)
    cut = rows.select(*keys, F.col(at).cast("long").alias("_at")).distinct().withColumn("_block", F.floor(F.col("_at") / block).cast("long"))
    inside = Window.partitionBy(*keys, "_block").orderBy("_at")
    found = cut.withColumn("_run", F.col("_at") - F.row_number().over(inside)).groupBy(*keys, "_block", "_run").agg(
        F.min("_at").alias("first"), F.max("_at").alias("last")).drop("_run")
    border = (F.col("first") == F.col("_block") * block) | (F.col("last") == (F.col("_block") + 1) * block - 1)
    order = Window.partitionBy(*keys).orderBy("first")
    touching = found.filter(border).withColumn("_new", (F.coalesce(F.lag("last").over(order) + 1 != F.col("first"), F.lit(True))).cast("long"))
    joined = touching.withColumn("_group", F.sum("_new").over(order)).groupBy(*keys, "_group").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return found.filter(~border).select(*keys, "first", "last").unionByName(joined.select(*keys, "first", "last"))
