"""Change detection and incremental builds: reuse what is unchanged, never the statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import index as I
from lodestone.operators.chunking import build_chunks


def change_detect(prior: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change) from two inventories (path, content_sha): added, changed, unchanged, removed.

    A file whose content is the same is unchanged even if it was touched; a blank digest never counts
    as known.
    """
    a = prior.select("path", F.col("content_sha").alias("before"))
    b = now.select("path", F.col("content_sha").alias("after"))
    same = (F.col("before") == F.col("after")) & (F.col("before") != "")
    change = (
        F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed")
        .when(same, "unchanged").otherwise("changed")
    )
    blank = F.lit("")
    return a.withColumn("before", F.coalesce("before", blank)).join(b.withColumn("after", F.coalesce("after", blank)), "path", "full_outer").select("path", change.alias("change"))


def inventory(files: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Source records; a digest is taken over where time and size are as before."""
    sha = F.sha2(F.col("content").cast("binary"), 256)
    if prior is None:
        return files.select("path", "extension", "mtime", "size", sha.alias("content_sha"))
    old = prior.select("path", F.col("mtime").alias("_mtime"), F.col("size").alias("_size"), F.col("content_sha").alias("_sha"))
    known = (F.col("mtime") == F.col("_mtime")) & (F.col("size") == F.col("_size")) & (F.col("_sha") != "")
    return files.join(old, "path", "left").select("path", "extension", "mtime", "size", F.when(known, F.col("_sha")).otherwise(sha).alias("content_sha"))


def update_chunks(chunks: DataFrame, docs: DataFrame, changed: DataFrame, size: int = 1500, overlap: int = 100, by: str = "headings") -> DataFrame:
    """Chunks after a change: kept ones with fresh times, new ones for added and changed documents.

    chunks are the prior ones, docs the documents as they are now, changed (path, change)."""
    stays = changed.filter("change = 'unchanged'").select("path")
    fresh = changed.filter(F.col("change").isin("added", "changed")).select("path")
    times = docs.select("collection", "path", F.col("mtime").alias("_mtime"))
    kept = chunks.join(stays, "path", "left_semi").join(times, ["collection", "path"]).withColumn("source_mtime", F.col("_mtime")).drop("_mtime")
    made = build_chunks(docs.join(fresh, "path", "left_semi"), size, overlap, by)
    return kept.select(*made.columns).unionByName(made)


def incremental_build(prior: I.Index, docs: DataFrame, changed: DataFrame, size: int = 1500, overlap: int = 100, by: str = "headings", embedder=None) -> I.Index:
    """A new index: chunks (and vectors) reused where possible, statistics made anew over everything."""
    chunks = update_chunks(prior.chunks, docs, changed, size, overlap, by)
    built = I.build(chunks, prior.stem, prior.k1, prior.b)
    if prior.vectors is None or embedder is None:
        return built
    fresh = changed.filter(F.col("change").isin("added", "changed")).select("path")
    kept = prior.vectors.join(changed.filter("change = 'unchanged'").select("path"), "path", "left_semi")
    made = embedder(chunks.join(fresh, "path", "left_semi").select(*I.KEY, "text")).select(*kept.columns)
    return built.with_vectors(kept.unionByName(made))
