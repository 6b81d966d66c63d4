"""The registered queries of the operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomrank.llm import collocations, compact_windows, decontaminate, license_scan, merkle, mixing, ngram_join, quality, rules, suffix_dedup, token_files, toxicity, url_filter
from roomrank.llm.shared import fresh_dir, table, written

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target weights: the square root of each source's size. Columns: doc_id, source, block, slot, place."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_table(spark, table(spark, sf_dir, "documents"), fresh_dir(spark, "tokens"), tokenizer_path(), END_ID)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.page_outcomes(table(spark, sf_dir, "labels")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = written(rules.base_counts(table(spark, sf_dir, "documents")), "rule-counts")
    return rules.judge(counted, counted=counted).withColumn("failed", F.concat_ws(",", "failed"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.near_passages(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents, verified against a table whose texts were tampered with for one id in five."""
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, merkle.tampered_text(docs))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_mixing": op1_mixing, "op2_token_files": op2_token_files, "op3_url_filter": op3_url_filter,
            "op4_toxicity": op4_toxicity, "op5_quality": op5_quality, "op6_ngram_join": op6_ngram_join, "op7_quality_rules": op7_quality_rules,
            "op8_suffix_dedup": op8_suffix_dedup, "op9_decontaminate": op9_decontaminate,
            "op10_compact_windows": op10_compact_windows, "op11_merkle": op11_merkle, "op12_license_scan": op12_license_scan, "op13_collocations": op13_collocations}
