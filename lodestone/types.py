"""Explicit schemas; nothing is inferred."""

from pyspark.sql import types as T

S, I, L, D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _of(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t, o[0] if o else True) for n, t, *o in fields])


SOURCES = _of(("path", S, False), ("extension", S, False), ("mtime", D, False), ("size", L, False), ("content_sha", S, False))
FILES = _of(*[(f.name, f.dataType) for f in SOURCES.fields], ("capture", S), ("content", S))
DOCS = _of(
    ("collection", S, False), ("path", S, False), ("title", S), ("folder", S), ("extension", S), ("mtime", D),
    ("content", S), ("summary", S), ("aliases", S), ("status", S), ("as_of", S),
)
CHUNKS = _of(
    ("collection", S, False), ("path", S, False), ("chunk_index", I, False), ("chunk_count", I, False), ("chunk_id", S, False),
    ("title", S), ("folder", S), ("breadcrumb", S), ("extension", S), ("source_mtime", D), ("aliases", S), ("status", S),
    ("as_of", S), ("piece", S), ("text", S),
)
VECTORS = _of(("collection", S, False), ("chunk_id", S, False), ("embedding", T.ArrayType(T.FloatType())))
POSTINGS = _of(("collection", S, False), ("term", S, False), ("path", S, False), ("chunk_index", I, False), ("tf", L, False), ("dl", L, False))
TERM_DF = _of(("collection", S, False), ("term", S, False), ("df", L, False))
STATS = _of(("collection", S, False), ("n", L, False), ("avgdl", D, False))
RANK_TERMS = _of(
    ("collection", S, False), ("path", S, False), ("chunk_index", I, False), ("status", S), ("content_terms", T.ArrayType(S)),
    ("name_terms", T.ArrayType(T.ArrayType(S))), ("path_terms", T.ArrayType(S)), ("meta_terms", T.ArrayType(S)),
)
