"""Token counts: an exact histogram of encoded lengths answers every question on context limits.

Documents are counted by their encoded length, with map-side combine. Sums from the long end then
give, for each length taken as a limit, how many documents exceed it and how many tokens remain
when longer documents are cut there. The histogram has no more rows than the longest text has
tokens; its running sums go by blocks of lengths, so no task holds more than one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilespark.llm.common import columns, pieces, stored
from tilespark.llm.tokens import encoder, tokenizer_path
from tilespark.operators.ordering import running_total

BLOCK = 1024


def token_lengths(docs: DataFrame, *, text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """One row per document: ``length``, its number of token ids (null or empty text: 0). Repeated rows are documents each; other columns, of
    any name, are not read; no documents: no rows."""
    path = tokenizer or tokenizer_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for piece in pieces(batch, "text"):
                yield pa.RecordBatch.from_pydict({"length": coder.lengths(piece.column("text"))})

    return columns(docs, text=text).mapInArrow(count, "length long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """``context_limit``, ``n_docs`` of exactly that length, ``n_longer`` above it, ``docs_upto`` up to it,
    ``total_tokens`` of all documents, ``truncated_tokens`` left when each is cut at the limit, and
    ``quantile``, the share of documents up to it. No documents: no rows. Repeated rows count each. Limits between two rows
    follow from :func:`at_limits`."""
    found = lengths.groupBy(F.col("length").alias("context_limit")).agg(F.count(F.lit(1)).alias("n_docs"))
    found = stored(found, "histogram")  # texts are encoded once, whatever is asked of the few rows after that
    found = found.withColumn("tokens", F.col("context_limit") * F.col("n_docs"))
    block = F.floor(-F.col("context_limit") / BLOCK)
    longest_first = [F.col("context_limit").desc()]
    found = running_total(found, (), block, longest_first, F.col("n_docs"), "_docs")
    found = running_total(found, (), block, longest_first, F.col("tokens"), "_tokens")
    every = found.agg(F.sum("n_docs").alias("_all_docs"), F.sum("tokens").alias("_all_tokens"))
    longer = F.col("_docs") - F.col("n_docs")
    longer_tokens = F.col("_tokens") - F.col("tokens")
    upto = F.col("_all_docs") - longer
    return found.crossJoin(every).select(
        "context_limit", "n_docs", longer.alias("n_longer"), upto.alias("docs_upto"), F.col("_all_tokens").alias("total_tokens"),
        (F.col("_all_tokens") - longer_tokens + longer * F.col("context_limit")).alias("truncated_tokens"),
        (upto / F.col("_all_docs")).alias("quantile"))


def at_limits(histogram: DataFrame, limits: DataFrame) -> DataFrame:
    """``context_limit, n_longer, truncated_tokens`` for any limits, each once, from the histogram; without documents no rows.

    A limit takes the last row at or below it: by blocks of lengths, whose last rows are carried forward. No task holds more than one
    block's rows, or one row per block. Null limits are left out.
    """
    held = F.when(F.col("n_docs").isNotNull(), F.struct(F.col("context_limit").alias("upto"), "n_longer", "truncated_tokens"))
    asked = limits.select(F.col("context_limit").cast("long").alias("context_limit")).filter("context_limit is not null").distinct()
    rows = histogram.select("context_limit", "n_docs", "n_longer", "truncated_tokens").unionByName(asked, allowMissingColumns=True)
    rows = rows.select("context_limit", held.alias("_row"), F.floor(F.col("context_limit") / BLOCK).alias("_block"))
    ends = rows.groupBy("_block").agg(F.max("_row").alias("_last"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col("_block").alias("_b"), F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy("_block").orderBy("context_limit", F.col("_row").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_at", F.last("_row", ignorenulls=True).over(inside)).filter(F.col("_row").isNull()).join(carried, F.col("_block") == F.col("_b"))
    found = found.select("context_limit", F.coalesce("_at", "_carried").alias("_at"))
    docs = histogram.agg(F.max(F.col("n_longer") + F.col("docs_upto")).alias("_docs")).filter("_docs is not null")  # one row
    limit, at = F.col("context_limit"), F.col("_at")
    return found.crossJoin(F.broadcast(docs)).select(
        "context_limit", F.coalesce(at.n_longer, F.col("_docs")).alias("n_longer"),
        F.coalesce(at.truncated_tokens + at.n_longer * (limit - at.upto), F.col("_docs") * limit).alias("truncated_tokens"))
