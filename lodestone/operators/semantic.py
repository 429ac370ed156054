"""Exact vector search for batches of queries, and the embedding backends.

Queries come in blocks of a bounded number of vectors; a block is a matrix that every task multiplies
with its batches of vectors, keeping each query's best rows so far, so a task gives out pool rows a
query instead of all pairs. A window over those picks the final pool.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import documents as D
from lodestone.functions import lexical as X
from lodestone.operators.bm25 import NUDGE, described, status_factor
from lodestone.operators.filters import Filters, clamp
from lodestone.operators.index import KEY, Index
from lodestone.runtime import written
from lodestone.settings import OperationError

DIGITS = 9
LEAST_POOL = 50
BLOCK = 1024


class EmbeddingBackend(Protocol):
    """Anything that turns texts into one row of numbers each; made anew in every worker."""

    model_name: str
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashedBackend:
    """Counts of words by a hash of the word; needs no weights and is the same everywhere."""

    model_name, dim = "hashed-64", 64

    def encode(self, texts: list[str]) -> np.ndarray:
        import regex

        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in zip(out, texts):
            for w in regex.findall(X.WORD, text.lower()):
                if w not in _STOP:
                    row[bucket(w)] += 1
        return out


def onnx_backend(model: str, tokenizer: str, dim: int, name: str | None = None, max_tokens: int = 256) -> type:
    """A backend class for a transformer encoder in a local ONNX file and its tokenizer's JSON file.

    Texts are cut to max_tokens and padded to the longest of a batch; token vectors are averaged under the attention mask,
    unless the model gives one vector a text. Both files must be at the same path on every executor."""

    class OnnxBackend:
        model_name = name or model

        def __init__(self):
            import onnxruntime
            from tokenizers import Tokenizer

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = 1  # a task has one core
            self.session = onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])
            self.inputs = {i.name for i in self.session.get_inputs()}
            self.tokenizer = Tokenizer.from_file(tokenizer)
            self.tokenizer.enable_truncation(max_tokens)
            self.tokenizer.enable_padding()

        def encode(self, texts: list[str]) -> np.ndarray:
            found = self.tokenizer.encode_batch(list(texts))
            ids, mask = (np.array([getattr(e, k) for e in found], dtype=np.int64) for k in ("ids", "attention_mask"))
            given = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
            out = self.session.run(None, {k: v for k, v in given.items() if k in self.inputs})[0].astype(np.float32)
            if out.ndim == 3:
                weight = mask[:, :, None].astype(np.float32)
                out = (out * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1)
            return out

    OnnxBackend.dim = dim
    return OnnxBackend


_STOP = frozenset(X.STOPWORDS)


@lru_cache(maxsize=100_000)
def bucket(word: str) -> int:
    return int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()[:2], 16) % HashedBackend.dim


def hashed_counts(text: Column) -> Column:
    """HashedBackend as a Column: for plans that should stay in the JVM."""
    buckets = F.transform(X.words(text), lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 2), 16, 10).cast("int") % HashedBackend.dim)
    return F.aggregate(
        buckets, F.array_repeat(F.lit(0.0), HashedBackend.dim),
        lambda a, i: F.concat(F.slice(a, F.lit(1), i), F.array(F.get(a, i) + 1.0), F.slice(a, i + 2, F.lit(HashedBackend.dim))),
    )


def embed(rows: DataFrame, text: str, backend: type, batch: int = 16) -> DataFrame:
    """rows with embedding: array<float>, by a backend class; checks shape and finite values."""
    name, kept = text, rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = backend()
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index(name)).to_pylist()]
            parts = []
            for i in range(0, len(texts), batch):
                got = np.asarray(made.encode(texts[i : i + batch]), dtype=np.float32)
                if got.shape != (len(texts[i : i + batch]), made.dim) or not np.isfinite(got).all():
                    raise ValueError(f"{made.model_name} gave vectors of shape {got.shape} or with values that are not finite")
                parts.append(got)
            flat = np.concatenate(parts).ravel() if parts else np.zeros(0, np.float32)
            offsets = pa.array(np.arange(0, len(flat) + 1, made.dim, dtype=np.int32))
            vectors = pa.ListArray.from_arrays(offsets, pa.array(flat, type=pa.float32()))
            yield pa.RecordBatch.from_arrays([*b.columns, vectors], names=[*b.schema.names, "embedding"])

    schema = T.StructType([*rows.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return rows.select(*kept).mapInArrow(run, schema)


def normalized(vector: Column) -> Column:
    """Unit length as doubles; a zero vector stays zero."""
    v = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: x / norm))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _cosines(matrix: np.ndarray, column: pa.Array) -> np.ndarray:
    """Queries times the vectors of an Arrow column, from its flat values."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != len(column) * matrix.shape[1] or np.any(np.diff(column.offsets.to_numpy()) != matrix.shape[1]):
        raise ValueError(f"vectors must have {matrix.shape[1]} numbers, as the queries")
    vectors = flat.reshape(len(column), -1)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.round(matrix @ (vectors / np.where(norms == 0, 1, norms)).T, DIGITS)


def _search(qids: list, matrix: np.ndarray, keep: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, list] = {}  # by collection: per query the scores and places kept so far
        for b in batches:
            if not b.num_rows:
                continue
            scores = _cosines(matrix, b.column(b.num_columns - 1))
            keys = list(zip(*(b.column(i).to_pylist() for i in range(len(names)))))
            for group in {k[0] for k in keys}:
                mine = [i for i, k in enumerate(keys) if k[0] == group]
                held = best.setdefault(group, [[] for _ in qids])
                for q, row in enumerate(scores[:, mine]):
                    # ties go by key, as they do in the final window
                    limit = np.partition(row, -keep)[-keep] if len(row) > keep else -np.inf
                    found = held[q] + [(-row[j], keys[i]) for j, i in enumerate(mine) if row[j] >= limit]
                    held[q] = sorted(found)[:keep]
        rows = [(qids[q], *k, -s) for held in best.values() for q, found in enumerate(held) for s, k in found]
        if rows:
            cols = list(zip(*rows))
            kinds = [None, *[None] * len(names), pa.float64()]
            arrays = [pa.array(c, type=t) if t else pa.array(c) for c, t in zip(cols, kinds)]
            arrays[0] = arrays[0].cast(pa.int64())
            if "chunk_index" in names:
                i = 1 + names.index("chunk_index")
                arrays[i] = arrays[i].cast(pa.int32())
            yield pa.RecordBatch.from_arrays(arrays, names=["qid", *names, "cosine"])

    return run


def _blocks(queries: DataFrame) -> Iterator[tuple[list[int], np.ndarray]]:
    """Ids and unit vectors of the queries, BLOCK at a time; with an embedding step they are embedded once."""
    asked = written(queries.select(F.col("qid").cast("long").alias("qid"), "embedding"), "asked").orderBy("qid")
    at = None
    while rows := (asked if at is None else asked.filter(F.col("qid") > at)).limit(BLOCK).collect():
        at = rows[-1]["qid"]
        m = np.array([r["embedding"] for r in rows], dtype=np.float64)
        if not np.isfinite(m).all():
            raise ValueError("query vectors must be finite")
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        yield [r["qid"] for r in rows], m / np.where(norms == 0, 1, norms)


def cosine_pool(vectors: DataFrame, queries: DataFrame, size: int) -> DataFrame:
    """(qid, collection, path, chunk_index, cosine, pool_rank): the nearest chunks of each query and
    collection. vectors: key and embedding; queries: qid (long) and embedding."""
    names = list(KEY)
    fields = ", ".join(f"{n} {dict(vectors.dtypes)[n]}" for n in names)
    found = [
        vectors.select(*names, "embedding").mapInArrow(_search(qids, m, size, names), f"qid long, {fields}, cosine double")
        for qids, m in _blocks(queries)
    ]
    if not found:
        spark = vectors.sparkSession
        return spark.createDataFrame([], "qid long, collection string, path string, chunk_index int, cosine double, pool_rank int")
    w = Window.partitionBy("qid", "collection").orderBy(F.desc("cosine"), "path", "chunk_index")
    return reduce(DataFrame.union, found).withColumn("pool_rank", F.row_number().over(w)).filter(F.col("pool_rank") <= size)


def _all(qids: list, matrix: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = _cosines(matrix, b.column(b.num_columns - 1))
            for qid, row in zip(qids, scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), qid)), *b.columns[:-1], pa.array(row)], names=["qid", *b.schema.names[:-1], "cosine"])

    return run


def cosine_all(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, key, cosine) of every query and every vector: a stated set of queries against all rows, in blocks."""
    fields = ", ".join(f"{n} {dict(vectors.dtypes)[n]}" for n in KEY)
    found = [vectors.select(*KEY, "embedding").mapInArrow(_all(qids, m), f"qid long, {fields}, cosine double") for qids, m in _blocks(queries)]
    if not found:
        return vectors.sparkSession.createDataFrame([], f"qid long, {fields}, cosine double")
    return reduce(DataFrame.union, found)


def lexical_boost(q: Column, names: Column, path: Column, content: Column) -> Column:
    """A small bonus for exact names, path and content terms, at most 0.30."""

    def share(a: Column) -> Column:
        return F.size(F.array_intersect(q, a)) / F.size(q)

    def name(n: Column) -> Column:
        inside = F.size(F.array_except(q, n)) == 0
        return F.when(inside & (F.size(n) == F.size(q)), F.lit(0.20)).when(inside, F.lit(0.08)).otherwise(0.04 * share(n))

    by_name = F.coalesce(F.array_max(F.transform(names, name)), F.lit(0.0))
    by_content = F.when(F.size(q) == 1, F.least(F.lit(0.02), 0.02 * share(content))).otherwise(F.least(F.lit(0.18), 0.22 * share(content)))
    total = by_name + F.when(F.size(path) > 0, 0.04 * share(path)).otherwise(F.lit(0.0)) + F.when(F.size(content) > 0, by_content).otherwise(F.lit(0.0))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.round(F.least(total, F.lit(0.30)) + NUDGE, DIGITS))


def semantic_search(index: Index, queries: DataFrame, top_k: int = 10, filters: Filters = Filters()) -> DataFrame:
    """Chunks per query and collection. score is the cosine; the order is by (cosine + boost) times the
    status factor. queries: qid, query, embedding."""
    if index.vectors is None:
        raise OperationError("the index has no vectors; rebuild it with a backend")
    top_k = clamp(top_k)
    asked = queries.filter(D.strip(F.col("query")) != "")
    vectors = index.vectors
    if not filters.empty:
        kept = index.chunks.filter(filters.predicate()).select(*KEY)
        vectors = vectors.join(kept, list(KEY), "left_semi")
    # written, as it is read twice: vectors of texts are made once
    pooled = written(cosine_pool(vectors, asked, max(top_k, LEAST_POOL)), "nearest")
    q = asked.select("qid", X.rank_terms(F.col("query"), True).alias("q"))
    rows = pooled.join(described(index, pooled).drop("meta_terms"), list(KEY)).join(q, "qid")
    boost = lexical_boost(F.col("q"), F.col("name_terms"), F.col("path_terms"), F.col("content_terms"))
    rows = rows.withColumn("boost", boost)
    rows = rows.withColumn("sort_score", F.round((F.col("cosine") + F.col("boost")) * status_factor(F.col("status")) + NUDGE, DIGITS))
    w = Window.partitionBy("qid", "collection").orderBy(F.desc("sort_score"), "pool_rank")
    out = rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)
    return out.select("qid", *KEY, "rank", F.col("cosine").alias("score"), "boost", "sort_score")
