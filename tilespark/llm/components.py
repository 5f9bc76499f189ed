"""Connected components of a link table, by alternating stars, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smallest neighbour to its larger neighbours. Minima are combined before the shuffle."""
    both = edges.select(F.col("u"), F.col("v")).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m"))
    return both.join(least, F.col("u") == F.col("_u")).filter(F.col("v") > F.col("u")).select(
        F.col("v").alias("u"), F.least("u", "_m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") != F.col("v"))
    least = down.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m"))
    to = down.join(least, F.col("u") == F.col("_u"))
    return to.select(F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(to.select("u", F.col("_m").alias("v"))).filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``node, component``: the smallest node reachable, for nodes that have links. Each round is written, so
    lineage stays short; stars make chains collapse in a logarithmic number of rounds."""
    edges = stored(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter(F.col("u") != F.col("v")), "links")
    before = None
    while True:
        edges = stored(_small_star(_large_star(edges)), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = now
