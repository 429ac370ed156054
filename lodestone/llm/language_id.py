"""Language identification by compression with per-language zstandard raw-content dictionaries.

Each language's dictionary is raw text of that language. A text is encoded in pieces of PIECE bytes
with every dictionary, so that its own repeats do not outweigh the dictionary, and goes to the
language with the smallest total, of equal ones to the more frequent language. The margin is the share by which the runner-up is larger; below
MIN_MARGIN the prediction is rejected (accepted is false), though the language is still named.

Dictionaries are fitted on a sample bounded per language: at most SAMPLE_DOCS labelled rows of every
language, chosen by a hash of id and text, equally much of each up to SAMPLE_CHARS, DICTIONARY_BYTES a
language. Every whole text is classified, in the scan, without a shuffle.

Defined results: null text and text without a letter get "und", score 0; rows without id or language
are not learned from; without any labelled row everything is "und"; repeated rows come out each; an empty table gives
an empty one; a very long text is encoded PIECE bytes at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.runtime import ship, written

SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 1500, 100_000
PIECE, LEVEL, MIN_MARGIN = 4096, 3, 0.02


def letters(text: Column) -> Column:
    """Lower-case letters with single spaces between words."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{M}]+", " ")))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(labelled: DataFrame) -> dict[str, bytes]:
    """Dictionaries from rows (doc_id, text, lang)."""
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # a row a language, of which dictionaries come to the driver below: broadcast, so that texts are not shuffled
    sizes = F.broadcast(written(usable.groupBy("lang").agg(F.count("*").alias("n")), "languages"))
    steps = 1 << 30
    # about twice SAMPLE_DOCS rows a language, or all, without a sort of whole languages; by id and text, so no hot id comes whole
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(steps)).cast("double") / steps
    some = usable.join(sizes, "lang").withColumn("place", place).filter(F.col("place") * F.col("n") < 2 * SAMPLE_DOCS)
    cut = some.select("lang", "doc_id", "place", letters(F.substring("text", 1, SAMPLE_CHARS)).alias("t"))
    w = Window.partitionBy("lang").orderBy("place", "doc_id", "t")
    rows = cut.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= SAMPLE_DOCS).join(sizes, "lang").collect()
    parts: dict[str, list[bytes]] = {}
    # languages in order of frequency; each row gives an equal share of the dictionary
    for r in sorted(rows, key=lambda r: (-r["n"], r["lang"], r["k"])):
        parts.setdefault(r["lang"], []).append(r["t"].encode("utf-8", "surrogatepass"))
    return {k: _even(v) for k, v in parts.items()}


def _even(rows: list[bytes]) -> bytes:
    """Rows joined in at most DICTIONARY_BYTES: short ones whole, of the others equally much."""
    left, share = DICTIONARY_BYTES - len(rows), 0
    for i, n in enumerate(sorted(map(len, rows))):
        share = left // (len(rows) - i)
        if n > share:
            break
        left, share = left - n, n
    return b" ".join(r[:share] for r in rows)


def _classify(dictionaries: dict[str, bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        names, packers = [], []
        for name, data in dictionaries.items():
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            # optimal parsing with matches from three bytes on: short texts need every match
            how = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, dict_size=len(data), min_match=3, strategy=zstandard.STRATEGY_BTOPT, write_checksum=0, write_content_size=0
            )
            d.precompute_compress(compression_params=how)
            names.append(name)
            packers.append(zstandard.ZstdCompressor(compression_params=how, dict_data=d).compress)
        for b in batches:
            found: list[tuple[str, float, float, bool]] = []
            for text in b.column(b.num_columns - 1):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if not data or not names:
                    found.append(("und", 0.0, 0.0, False))
                    continue
                pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
                sizes = [sum(len(pack(p)) for p in pieces) for pack in packers]
                order = sorted(range(len(names)), key=lambda k: (sizes[k], k))
                margin = 1.0 if len(order) == 1 else 1 - sizes[order[0]] / sizes[order[1]]
                found.append((names[order[0]], 1 - math.exp(-25 * margin), margin, margin >= MIN_MARGIN))
            types = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            cols = zip(*found) if found else ([], [], [], [])
            arrays = [*b.columns[:-1], *(pa.array(c, type=t) for c, t in zip(cols, types))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*b.schema.names[:-1], "lang_pred", "score", "margin", "accepted"])

    return run


def predict(docs: DataFrame, dictionaries: dict[str, bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, margin and accepted of every document."""
    ship(docs.sparkSession)
    has = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.when(has, letters(F.col(text))).alias("t"))
    return rows.mapInArrow(_classify(dictionaries), "doc_id long, lang_pred string, score double, margin double, accepted boolean")
