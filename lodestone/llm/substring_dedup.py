"""Substring dedup over words: Rabin-Karp hashes of every 35-word window, counted; repeated windows merge.

A window's hash is a difference of prefix sums over its block. All windows of the corpus are counted in Spark
(see repeats), and those found twice once more by an independent second hash. The words that repeated
windows cover merge into maximal removal intervals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from lodestone.llm import repeats

SPAN = 35


def find(docs: DataFrame, **columns: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_spans of every document."""
    found = repeats.digests(docs, "words", SPAN, **columns)
    return found.select("doc_id", found.n_units.alias("n_words"), "n_removed", "kept_sha256", "n_spans")


def remove(docs: DataFrame, **columns: str) -> DataFrame:
    return repeats.remove(docs, "words", SPAN, **columns)
