"""Stacked imagery: ordered blends and band arithmetic."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blend(base: Column, top: Column, alpha: Column) -> Column:
    """Opacity blend of two 8-bit values, truncated; an opacity outside 0..1 saturates."""
    mixed = base + alpha * (top - base)
    return (
        F.when(alpha.isNull() | (alpha >= 1.0), top)
        .when(alpha == 0.0, base)
        .otherwise(F.least(F.greatest(mixed, F.lit(0.0)), F.lit(255.0)).cast("int").cast("double"))
    )


def fold_stack(
    layers: DataFrame, by: Sequence[str], order: Sequence[str], value: str, alpha: str,
    merge: Callable[[Column, Column, Column], Column] = blend, start: float = 0.0,
) -> DataFrame:
    """Fold each pixel's layers in order; ``merge(base, top, alpha)`` may be replaced.

    A pixel has one entry per layer of its map, a bounded handful.
    """
    entry = F.struct(*[F.col(c) for c in order], F.col(value).cast("double").alias("_v"), F.col(alpha).alias("_a"))
    stacked = layers.groupBy(*by).agg(F.sort_array(F.collect_list(entry)).alias("_stack"))
    folded = F.aggregate("_stack", F.lit(start), lambda acc, e: merge(acc, e["_v"], e["_a"]))
    return stacked.select(*by, folded.alias("value"), F.size("_stack").alias("n_layers"))


def merge_bands(pixels: DataFrame, by: Sequence[str], image: str, band: str, value: str, ops: Sequence[tuple[str, object, object, float]]) -> DataFrame:
    """Weighted sums of source bands per output band.

    ``ops``: (output band, source image, source band, factor). The few operations become conditional
    sums, so one aggregation makes all bands; bands without a source are 0.
    """
    weights: dict[str, dict[tuple, float]] = {}
    for out, img, src, factor in ops:
        table = weights.setdefault(out, {})
        table[img, src] = table.get((img, src), 0.0) + factor
    sums = []
    for out, table in weights.items():
        weight = F
        for (img, src), factor in table.items():
            weight = weight.when((F.col(image) == img) & (F.col(band) == src), factor)
        sums.append(F.sum(F.col(value) * weight.otherwise(0.0)).alias(out))
    return pixels.groupBy(*by).agg(*sums)
