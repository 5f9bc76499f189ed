"""The operators applied to whole tables, with production parameters, under the columns agreed for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.llm import decontamination, licences, mixing, ngram_join, packing, passages, prefix_trie, quality_rules, spelling, token_counts, token_output, toxicity, url_trust
from tilespark.llm.common import columns, prepare, table
from tilespark.llm.oracles import ORACLES as ORACLES


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sizes_only(table(prepare(spark), sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(token_counts.token_lengths(table(prepare(spark), sf_dir, "documents")))


def op3_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_trust.judge_urls(table(prepare(spark), sf_dir, "pages"))
    return judged.withColumns({c: F.round(c, 6) for c in ("trust", "distrust")})


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "labels")
    judged = toxicity.classify(columns(docs, doc_id="doc_id", text="text", lang="lang"), labels, keep_text=False)
    return judged.withColumn("held_out", toxicity.held_out(judged["doc_id"])).select("doc_id", "held_out", "score", "predicted", "threshold", "rejected")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.read_digests(token_output.write_tokens(table(prepare(spark), sf_dir, "documents")))


def op6_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(prepare(spark), sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes_and_components(table(prepare(spark), sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(prepare(spark), sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_out")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = columns(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    marked = decontamination.mark_contaminated(docs, table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    found = licences.scan(table(spark, sf_dir, "documents"), licences.known_licences(spark))
    return found.withColumn("licences", F.array_join("licences", ","))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(prepare(spark), sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(prepare(spark), sf_dir, "conversations"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(prepare(spark), sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (
    op1_source_mix, op2_token_counts, op3_url_trust, op4_toxicity, op5_token_files, op6_passage_dedup, op7_ngram_jaccard, op8_quality_rules, op9_decontamination,
    op10_license_scan, op11_packing, op12_prefix_trie, op13_spelling)}
