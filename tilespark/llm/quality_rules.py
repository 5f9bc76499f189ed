"""Quality rules by document and by host, with DataFrame functions only.

Each text is measured in its own row. A host's documents are then counted by rule that they fail;
the share of failures is shrunk towards the share over all hosts by a beta prior whose strength is
taken from the spread between hosts (method of moments), so a host with three documents is not
judged by two bad ones. Hosts whose shrunk share passes the limit for any rule are out, and their
verdict is joined back to their documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.functions.once import bind, once
from tilespark.llm.common import BLANK, stored

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def _repeated(words: Column) -> Column:
    """Words that lie in a window of eight words found twice or more in the text.

    Window hashes are compared within the text only. Texts whose hashes all differ end there; others
    sort hashes with their places, keep the places whose neighbour has the same hash, and add up
    the gaps between places, eight words at most for each.
    """
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def places(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return bind(pairs, lambda s: F.array_sort(F.transform(
            F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                     | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.get(p, i + 1) - x)), F.lit(0).cast("long"), lambda a, x: a + x)

    count = bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(bind(places(h), covered)))
    return F.when(F.size(words) >= WINDOW, count).otherwise(F.lit(0).cast("long"))


def figures(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``doc_id, host`` and what is measured of each whole text; null text has no words and no lines."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{host}`").alias("host"), body.alias("body"))
    rows = once(rows, "words", F.filter(F.split("body", BLANK), lambda w: w != ""))
    rows = once(rows, "lines", F.filter(F.split("body", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    return rows.select(
        "doc_id", "host", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("body", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"), _repeated(F.col("words")).alias("n_repeat_words"))


@dataclass(frozen=True)
class Rules:
    """Limits of the rules. A document fails one when its figure passes the limit."""

    least_words: int = 20
    most_repeat_pct: int = 30
    most_symbol_pct: int = 50
    most_dup_line_pct: int = 50
    least_word_chars: int = 2
    most_word_chars: int = 20
    #: A host whose shrunk share of failing documents is above this, for any rule, is out.
    most_host_share: float = 0.5

    def base(self) -> Column:
        n = F.col("n_words")
        return (n < self.least_words) | (100 * F.col("n_repeat_words") > self.most_repeat_pct * n)

    def failures(self) -> dict[str, Column]:
        n = F.col("n_words")
        return {
            "short": n < self.least_words, "repeats": 100 * F.col("n_repeat_words") > self.most_repeat_pct * n,
            "symbols": 100 * F.col("n_symbols") > self.most_symbol_pct * n,
            "lines": 100 * F.col("n_dup_lines") > self.most_dup_line_pct * F.col("n_lines"),
            "word_length": (F.col("word_chars") < self.least_word_chars * n) | (F.col("word_chars") > self.most_word_chars * n)}


def host_verdicts(measured: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``host, n_docs, host_out`` and per rule the shrunk share ``share_<rule>``; a null host is a host.

    The prior's mean is the share over all documents. Its strength comes from the hosts' shares
    weighted by documents: with their variance ``v`` beyond what chance gives, it is
    ``mean * (1 - mean) / v - 1``; without such spread every host gets the mean. One row of totals
    is joined to the hosts, and hosts are counted with map-side combine.
    """
    failed = rules.failures()
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *[F.sum(c.cast("long")).alias(f"n_{r}") for r, c in failed.items()])
    n = F.col("n_docs").cast("double")
    moments = [F.sum(n).alias("_n"), F.sum(n * n).alias("_nn"), F.count(F.lit(1)).alias("_hosts")]
    for r in failed:
        moments += [F.sum(f"n_{r}").cast("double").alias(f"_k_{r}"), F.sum(F.col(f"n_{r}") * F.col(f"n_{r}") / n).alias(f"_q_{r}")]
    hosts = hosts.crossJoin(F.broadcast(hosts.agg(*moments)))  # one row
    for r in failed:
        mean = F.col(f"_k_{r}") / F.col("_n")
        chance = mean * (1 - mean)
        # between-host variance by the moments of a one-way layout
        spread = (F.col(f"_q_{r}") - F.col("_n") * mean * mean - (F.col("_hosts") - 1) * chance) / F.nullif(F.col("_n") - F.col("_nn") / F.col("_n"), F.lit(0.0))
        strength = F.when(spread > 0, F.greatest(chance / spread - 1, F.lit(1.0)))
        hosts = hosts.withColumn(f"share_{r}", F.when(strength.isNull(), mean).otherwise((F.col(f"n_{r}") + mean * strength) / (n + strength)))
    out = F.greatest(*[F.col(f"share_{r}") for r in failed]) > rules.most_host_share
    return hosts.select("host", "n_docs", out.alias("host_out"), *[f"share_{r}" for r in failed])


def judge(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """``doc_id, host``, the figures, ``base_failed``, ``failed`` (all rules that it fails), ``host_out`` and ``kept``.

    Kept are documents that fail no rule and whose host is not out. Null and empty texts fail the first
    rule. Repeated rows are judged one by one. An empty table gives no rows. Other columns are not read.
    """
    measured = stored(figures(docs, doc_id=doc_id, text=text, host=host), "figures")
    hosts = host_verdicts(measured, rules).select(F.col("host").alias("_host"), "host_out")
    failed = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in rules.failures().items()]))
    rows = measured.withColumn("base_failed", rules.base()).withColumn("failed", failed)
    rows = rows.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    return rows.withColumn("kept", (F.size("failed") == 0) & ~F.col("host_out"))
