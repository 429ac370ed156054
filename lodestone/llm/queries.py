"""The registered queries: thin projections of each operator's result onto its contract columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, language_id, line_dedup, oracles, packing, quality_classifier, quality_rules, simhash, substring_dedup, suffix_dedup, tokens
from lodestone.runtime import scratch, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.find(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = language_id.fit(docs.select("doc_id", "text", "lang").filter(~language_id.held_out(F.col("doc_id"))))
    found = language_id.predict(docs, learned)
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "accepted")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return quality_classifier.classify(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.find(table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.cluster(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "tokens")
    tokens.write_tokens(table(spark, sf_dir, "documents"), out)
    return tokens.read_documents(spark, out)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), lang="lang")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_line_dedup": op2_line_dedup,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_language_id": op5_language_id,
    "op7_quality_classifier": op7_quality_classifier,
    "op6_substring_dedup": op6_substring_dedup,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_token_output": op9_token_output,
    "op10_quality_rules": op10_quality_rules,
}

ORACLES: dict[str, str] = {
    "op3_benchmark_decontamination": oracles.OP3,
    "op10_quality_rules": oracles.OP10,
}
