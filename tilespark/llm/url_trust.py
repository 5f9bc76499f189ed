"""URL filters: rules by host and path, and trust spread over the link graph for what no rule names.

Hosts with mostly allowed pages are trusted, hosts with mostly blocked pages distrusted. Trust runs
along links from the trusted (personalised PageRank); distrust runs against them from the blocked,
as linking to bad hosts is a bad sign. A host whose distrust passes its trust, and a floor, is
blocked. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.functions.once import once
from tilespark.llm.common import stored

#: verdict, rule
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = "(?i)<a\\s[^>]*?href\\s*=\\s*[\"']?\\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\\s>]+)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up
    to ``?``, ``#`` or the end. Both empty for null and without ``://``."""
    return (F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit("")), F.coalesce(F.regexp_extract(url, _URL, 2), F.lit("")))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, as ``struct<size, rule, verdict>``, or null. The list is an argument, so it is small."""
    fits = []
    for verdict, rule in rules:
        domain, slash, rest = rule.partition("/")
        ok = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(slash + rest)
        fits.append(F.when(ok, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    if not fits:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    return F.array_max(F.array(*fits))


def host_links(pages: DataFrame) -> DataFrame:
    """``src, dst, links``: links between different hosts, counted before they are shuffled."""
    linked = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(_LINK), F.lit(1))
    rows = pages.filter(F.col("host") != "").select(F.col("host").alias("src"), F.explode(linked).alias("dst"))
    rows = rows.select("src", F.translate("dst", _UPPER, _LOWER).alias("dst"))
    return rows.filter(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def spread(edges: DataFrame, seeds: DataFrame, *, steps: int = 20, damping: float = 0.85, cut: int = 5) -> DataFrame:
    """``kind, host, score`` from ``seeds`` (``kind, host, start``: shares that add up to 1 per kind) over
    ``edges`` (``kind, src, dst, share``). What reaches hosts without links on ends there. Every ``cut``
    steps the scores are written, so that a lost executor doesn't start it anew."""
    start = seeds.select("kind", "host", F.col("start").alias("score"))
    links = edges.select(F.col("kind").alias("_kind"), F.col("src").alias("_src"), "dst", "share")
    scores = start
    for step in range(steps):
        passed = scores.join(links, (F.col("kind") == F.col("_kind")) & (F.col("host") == F.col("_src"))).select(
            "kind", F.col("dst").alias("host"), (F.lit(damping) * F.col("score") * F.col("share")).alias("score"))
        scores = passed.unionByName(start.withColumn("score", (1 - damping) * F.col("score"))).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if step % cut == cut - 1 and step < steps - 1:
            scores = stored(scores, "scores")
    return scores


def host_scores(pages: DataFrame, *, steps: int = 20) -> DataFrame:
    """``host, trust, distrust`` of hosts that trust or distrust reaches.

    ``pages`` has ``host, html, ruled`` (the rule's verdict or null). Scores are relative to the mean
    share of a host, so the floor means the same for few and for many hosts.
    """
    counted = pages.filter(F.col("host") != "").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    counted = stored(counted, "hosts")
    edges = stored(host_links(pages), "links")
    known = counted.select(F.col("host"), F.when(2 * F.col("allowed") > F.col("n"), "trust").when(2 * F.col("blocked") > F.col("n"), "distrust").alias("kind"))
    known = known.filter(F.col("kind").isNotNull())
    seeds = known.join(known.groupBy("kind").agg(F.count(F.lit(1)).alias("_n")), "kind").select("kind", "host", (1 / F.col("_n")).alias("start"))
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "links").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "links"))
    out = both.groupBy(F.col("kind").alias("_kind"), F.col("src").alias("_src")).agg(F.sum("links").alias("_out"))
    both = stored(both.join(out, (F.col("kind") == F.col("_kind")) & (F.col("src") == F.col("_src"))).select(
        "kind", "src", "dst", (F.col("links") / F.col("_out")).alias("share")), "edges")
    scores = spread(both, seeds, steps=steps)
    total = counted.agg(F.count(F.lit(1)).alias("_hosts"))
    by_host = scores.groupBy("host").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")])
    return by_host.crossJoin(F.broadcast(total)).select(  # one row
        "host", (F.col("trust") * F.col("_hosts")).alias("trust"), (F.col("distrust") * F.col("_hosts")).alias("distrust"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, *, page_id: str = "page_id", url: str = "url", html: str = "html",
               steps: int = 20, floor: float = 0.05) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for every row.

    The rule's verdict holds; without a rule, the host's: block when its distrust is above ``floor`` (in
    mean shares of a host) and above its trust, else allow. Null urls and such without ``://`` have
    empty host and path and are allowed; null pages have no links. Repeated rows are judged one by one.
    An empty table gives no rows. Other columns are not read.
    """
    host, path = host_and_path(F.col(f"`{url}`"))
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), host.alias("host"), path.alias("path"), F.col(f"`{html}`").alias("html"))
    rows = once(rows, "_rule", rule_for(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "host", "path", "html", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("ruled"))
    scores = host_scores(rows.select("host", "html", "ruled"), steps=steps).withColumnRenamed("host", "_host")
    judged = rows.drop("html").join(scores, F.col("host") == F.col("_host"), "left")
    trust, distrust = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("trust", "distrust"))
    own = F.when((distrust > floor) & (distrust > trust), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
