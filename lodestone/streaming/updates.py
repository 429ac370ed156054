"""A stream of changed documents kept up to date in a published index.

The batch engine polls; this is the same incremental build driven by Structured Streaming. Each micro-batch holds
whole documents (types.DOCS); the last version of a path in a batch counts, and null content removes it.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import types
from lodestone.operators import incremental
from lodestone.operators import index as I
from lodestone.operators.chunking import build_chunks
from lodestone.settings import Settings
from lodestone.sources import store


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(types.DOCS).json(path)


def apply_batch(batch: DataFrame, root: Path, collection: str, settings: Settings) -> store.Manifest | None:
    """Merge one micro-batch into the published index; running it again changes nothing."""
    spark = batch.sparkSession
    last = Window.partitionBy("path").orderBy(F.desc("mtime"), F.desc("content"))
    docs = batch.filter(F.col("collection") == collection).withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")
    if docs.limit(1).count() == 0:
        return None
    now = incremental.inventory(docs.filter("content is not null").withColumn("size", F.octet_length("content").cast("long")))
    with store.writer_lock(root):
        prior = store.load(spark, root)
        if prior is None:
            made = I.build(build_chunks(docs.filter("content is not null"), settings.chunk_size, settings.overlap), settings.stem, settings.k1, settings.b)
            return store.publish(root, collection, made, now, settings)
        _, index, sources = prior
        rest = sources.join(docs.select("path"), "path", "left_anti")
        after = rest.unionByName(now.select(*rest.columns))
        changed = incremental.change_detect(sources, after)
        # kept documents only bring their times; their chunks are reused
        kept = index.chunks.select("collection", "path", F.col("source_mtime").alias("mtime")).distinct().join(docs.select("path"), "path", "left_anti")
        both = docs.filter("content is not null").unionByName(kept, allowMissingColumns=True)
        made = incremental.incremental_build(index, both, changed, settings.chunk_size, settings.overlap)
        return store.publish(root, collection, made, after, settings)


def maintain(stream: DataFrame, root: Path, collection: str, settings: Settings, checkpoint: str):
    """Start the stream; each micro-batch publishes a generation."""
    return (
        stream.writeStream.foreachBatch(lambda batch, _: apply_batch(batch, root, collection, settings) and None)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
