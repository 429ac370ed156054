"""Suffix-array dedup over bytes: remove what a 400-byte string covers that also starts elsewhere.

Prefix doubling: every position is ranked by the string that starts there, first of 64 bytes, then of 128, 256 and
400, each rank made from the pair of ranks at the position and at the last length (for 400, at 144) after
it. The positions of a round are sorted by rank over all tasks (see repeats); a position whose rank is
unique is dropped, the rest go on to the next offset until they are past the threshold. Ranks are hashes,
so positions with equal strings have equal ranks wherever they stand; the order of unequal strings is
not needed. The first rank is taken at anchors only: the 64-byte string with the least hash in each
400-byte window. A window whose anchor is unique cannot be repeated, so its start is not ranked at all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from lodestone.llm import repeats

SPAN, KEY = 400, 64


def find(docs: DataFrame, **columns: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return repeats.digests(docs, "bytes", SPAN, KEY, **columns).withColumnRenamed("n_units", "n_bytes")


def remove(docs: DataFrame, **columns: str) -> DataFrame:
    return repeats.remove(docs, "bytes", SPAN, KEY, **columns)
