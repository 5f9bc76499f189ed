"""Which layer answers a request: by resolution, reference system, name, coverage and priority."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilespark.functions import geometry as geo


def renders(layers_and_queries: DataFrame, res: Column) -> DataFrame:
    """Pairs whose layer shows the query's resolution."""
    return layers_and_queries.filter(geo.in_resolution_range(res, F.col("min_res"), F.col("max_res")))


def scale_to_resolution(scale: Column) -> Column:
    """Resolution in metres per pixel of a scale denominator."""
    return scale * 0.00028


def resolution_range(min_res: Column, max_res: Column, min_scale: Column, max_scale: Column) -> Column:
    """Range from resolutions, else from scale denominators; zero and null leave it unset."""
    def given(a, b):
        return F.coalesce((a != 0) & (b != 0), F.lit(False))

    return (
        F.when(given(min_res, max_res), F.struct(min_res.alias("min_res"), max_res.alias("max_res")))
        .when(given(min_scale, max_scale), F.struct(
            scale_to_resolution(max_scale).alias("min_res"), scale_to_resolution(min_scale).alias("max_res")))
    )


def route_by_resolution(res: Column, limit: Column, coarse: Column, fine: Column) -> Column:
    return F.when(res > limit, coarse).otherwise(fine)


def route_by_srs(queries: DataFrame, layers: DataFrame, preferred: DataFrame, by: str = "name") -> DataFrame:
    """Layer variant per query: its own system, else the first preferred one offered, else the first.

    ``layers``: (by, srs, ordinal, layer_id); ``preferred``: (query_srs, srs, rank). The three lookups
    are tables of layer size that the planner broadcasts while they are small; queries are not
    regrouped for them.
    """
    choice = F.struct(F.col("srs").alias("layer_srs"), "layer_id")
    own = layers.select(by, "srs", choice.alias("_own"))
    ranked = preferred.withColumnRenamed("srs", "_offered").join(
        layers.withColumnRenamed("srs", "_offered").withColumn("srs", F.col("_offered")), "_offered")
    wished = ranked.groupBy(by, F.col("query_srs").alias("_query_srs")).agg(F.min_by(choice, "rank").alias("_wished")).withColumnRenamed(
        "_query_srs", "srs")
    first = layers.groupBy(by).agg(F.min_by(choice, "ordinal").alias("_first"))
    found = queries.join(own, [by, "srs"], "left").join(wished, [by, "srs"], "left").join(first, by, "left")
    return found.select(*queries.columns, F.coalesce("_own", "_wished", "_first").alias("_c")).select(*queries.columns, "_c.*")


def resolve_layer_names(requests: DataFrame, layers: DataFrame, suffixes: Sequence[str] = ("_EPSG900913", "_EPSG4326")) -> DataFrame:
    """Layer of ``layer[_layer_spec]``: the plain name, else the first known suffix."""
    name = F.when(F.col("layer_spec").isNull(), F.col("layer")).otherwise(F.concat_ws("_", "layer", "layer_spec"))
    found, hits = requests.withColumn("_name", name), []
    for i, suffix in enumerate(("", *suffixes)):
        table = layers.select(F.col("layer_name").alias(f"_n{i}"), F.struct("layer_name", "layer_id").alias(f"_l{i}"))
        found = found.join(table, F.concat("_name", F.lit(suffix)) == F.col(f"_n{i}"), "left")
        hits.append(f"_l{i}")
    return found.select(*requests.columns, F.coalesce(*hits).alias("_l")).select(*requests.columns, "_l.*")


def first_by_priority(candidates: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the smallest in ``order``, combined on the map side."""
    rest = [c for c in candidates.columns if c not in by]
    rank = F.struct(*order)
    picked = candidates.groupBy(*by).agg(F.min_by(F.struct(*rest), rank).alias("_p"))
    return picked.select(*by, "_p.*").select(*candidates.columns)


def eligible_sources(tiles: DataFrame, pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sources able to answer each tile; a tile none can answer keeps one row with an error.

    ``pairs``: tile key, source, failed. Uncovered sources are not among the pairs.
    """
    usable = pairs.filter(~F.col("failed")).drop("failed")
    joined = tiles.join(usable, list(by), "left")
    return joined.withColumn("error", F.when(F.col("source").isNull(), "no source"))


def status_policy(responses: DataFrame, policies: DataFrame) -> DataFrame:
    """Fallback per response: the policy of its code, else of ``other``, else none.

    ``policies``: (code, color, cacheable), a handful of rows the planner broadcasts.
    """
    entry = F.struct(F.col("code").alias("policy"), "color", "cacheable")
    exact = policies.select("code", entry.alias("_exact"))
    other = policies.filter("code = 'other'").select(F.col("code").alias("_any"), entry.alias("_other"))
    found = responses.join(exact, "code", "left").join(other, F.lit("other") == F.col("_any"), "left")
    return found.select(*responses.columns, F.coalesce("_exact", "_other").alias("_p")).select(*responses.columns, "_p.*")


def is_opaque(in_range: Column, transparent: Column, opacity: Column, covers: Column) -> Column:
    """Nothing beneath can show: within range, no alpha, no part opacity, coverage holds the query."""
    faded = F.coalesce((opacity > 0.0) & (opacity < 0.99), F.lit(False))
    return in_range & ~F.coalesce(transparent, F.lit(False)) & ~faded & F.coalesce(covers, F.lit(True))


def cut_hidden(stack: DataFrame, by: Sequence[str], order: str, opaque: str = "opaque") -> DataFrame:
    """Drop layers beneath the topmost opaque one; a request lists a bounded number of layers."""
    top = F.max(F.when(F.col(opaque), F.col(order))).over(Window.partitionBy(*by))
    return stack.withColumn("_top", top).filter(F.col("_top").isNull() | (F.col(order) >= F.col("_top"))).drop("_top")


def combine_requests(stack: DataFrame, by: Sequence[str], order: Sequence[str], same: Sequence[str], blocked: Column) -> DataFrame:
    """Merge neighbouring layers one upstream request can answer.

    Neighbours combine when ``same`` columns agree and neither is ``blocked``. A request lists a
    bounded number of layers, so its window is small. Returns one row per upstream request.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    state = F.struct(*[F.col(c) for c in same])
    changed = F.when(
        (F.row_number().over(w) == 1) | F.col("_blocked") | F.lag("_blocked").over(w) | ~state.eqNullSafe(F.lag(state).over(w)), 1
    ).otherwise(0)
    flagged = stack.withColumn("_blocked", blocked).withColumn("_new", changed)
    numbered = flagged.withColumn("request_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = numbered.withColumn("_at", F.row_number().over(w))
    return ranked.groupBy(*by, "request_no").agg(
        *[F.first(c).alias(c) for c in same], F.count(F.lit(1)).alias("n_layers"),
        F.transform(F.sort_array(F.collect_list(F.struct("_at", "layer"))), lambda s: s["layer"]).alias("layers"))
