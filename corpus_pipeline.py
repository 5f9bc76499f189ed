"""A training corpus from raw documents, stage by stage; each stage is one operator of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tilespark.llm import decontamination, mixing, ngram_join, token_output, toxicity
from tilespark.llm.common import prepare, shared_path, table

#: Rows go to Python in smaller batches than an operator alone has: workers and the executors' buffers keep what the largest batch took, over all stages.
BATCH = 4 << 20

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject; the labels' own held-out third is not learnt from. Rows are judged one by one, repeated ones
    too. Null and empty texts have no words; null ids have no label. An empty table stays empty; without labels of both classes nothing goes."""
    return toxicity.without_toxic(docs, table(prepare(spark, BATCH), sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies; of rows with that id one. Null and empty texts and null ids are in no group
    and stay; equal rows with an id are one."""
    prepare(spark, BATCH)
    return ngram_join.one_of_each(docs)


def clean_of_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with a benchmark item. Null and empty texts share none; repeated rows go or stay together; without items all stay."""
    prepare(spark, BATCH)
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document may be there up to three times. A null source is one like others; null and empty texts have no
    size and are taken as often as their source; repeated rows are documents each."""
    prepare(spark, BATCH)
    return mixing.take(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of every document, and what they hold as read back. Null and empty texts are an end mark; null ids come first; repeated rows are documents
    each. Other columns of any name are carried through the stages before and not read here."""
    prepare(spark, BATCH)
    return token_output.read_digests(token_output.write_tokens(docs))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("ngram_jaccard", without_copies),
    ("benchmark_decontamination", clean_of_tests),
    ("source_mixing", mixed),
    ("token_files", token_files),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's rows are written as Parquet and read again for the next."""
    docs = table(prepare(spark, BATCH), sf_dir, "documents")
    folder = shared_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
