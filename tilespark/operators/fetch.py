"""Upstream fetching: admission, rate-limited schedules and the content cache."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.functions import requests as req
from tilespark.operators.ordering import ranked_sort


@dataclass(frozen=True)
class FetchRule:
    """Rate limit for the hosts its pattern matches; rules are tried in list order."""

    host_pattern: str
    delay_ms: int
    parallelism: int = 1


def admit(
    urls: DataFrame, deny: Sequence[str] = (), allow: Sequence[str] = (),
    denied_hosts: DataFrame | None = None, allowed_hosts: DataFrame | None = None,
) -> DataFrame:
    """Add ``reason`` (null: may be fetched). Host lists are tables ``host`` and meet by equi-join."""
    out = urls.withColumn("host", req.url_host(F.col("url")))
    denied, allowed = F.lit(False), F.lit(True)
    if denied_hosts is not None:
        out = out.join(denied_hosts.select("host").distinct().withColumn("_denied", F.lit(True)), "host", "left")
        denied = F.coalesce(F.col("_denied"), F.lit(False))
    if allowed_hosts is not None:
        out = out.join(allowed_hosts.select("host").distinct().withColumn("_allowed", F.lit(True)), "host", "left")
        allowed = F.coalesce(F.col("_allowed"), F.lit(False))
    return out.withColumn("reason", req.admission_reason(F.col("url"), deny, allow, denied, allowed)).select(
        *urls.columns, "host", "reason")


def matching_rule(host: Column, rules: Sequence[FetchRule]) -> Column:
    """Position of the first rule matching a host, null when none does."""
    out = F
    for i, rule in enumerate(rules):
        out = out.when(host.rlike(rule.host_pattern), i)
    return out.otherwise(F.lit(None).cast("int"))


def schedule(urls: DataFrame, rules: Sequence[FetchRule], bucket: Column, order: Sequence[str]) -> DataFrame:
    """Start offset per URL: ``parallelism`` fetches of a host run at once, ``delay`` apart.

    A host's queue position comes from order-preserving buckets, so one host holding a third of all
    URLs is numbered by many tasks. Hosts without a rule start at once.
    """
    ruled = urls.withColumn("rule", matching_rule(F.col("host"), rules))
    queued = ranked_sort(ruled, ["host"], bucket, order, "position")

    def setting(values):
        out = F
        for i, value in enumerate(values):
            out = out.when(F.col("rule") == i, value)
        return out.otherwise(F.lit(None).cast("int"))

    wave = F.floor((F.col("position") - 1) / setting([max(r.parallelism, 1) for r in rules]))
    offset = wave * setting([r.delay_ms for r in rules])
    return queued.withColumn("start_ms", F.coalesce(offset, F.lit(0)).cast("long"))


def repeat_share(fetches: DataFrame, by: Sequence[str] = ("host",)) -> DataFrame:
    """How much of a fetch log asks for a URL again after its first good fetch, by aggregation.

    ``fetches``: url, seq (ordered), ok, cacheable. ``misses`` counts the first good fetches of cacheable URLs, ``hits`` the cacheable
    fetches after them; fetches before them, uncacheable ones and URLs never fetched count as neither.
    """
    asked = fetches.filter("cacheable")
    filled = asked.filter("ok").groupBy("url").agg(F.min("seq").alias("filled_at"))
    return asked.join(filled, "url").groupBy(*by).agg(
        F.count_if(F.col("seq") > F.col("filled_at")).alias("hits"), F.count_if(F.col("seq") == F.col("filled_at")).alias("misses"),
    ).withColumn("hit_ratio", F.col("hits") / (F.col("hits") + F.col("misses")))
