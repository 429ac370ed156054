import hashlib

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from helpers import compare
from lodestone.llm.queries import ORACLES, QUERIES
from lodestone.runtime import written


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, duck, name):
    assert compare(QUERIES[name](spark, sf), duck, ORACLES[name]) > 0


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_stages_follow_each_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == columns
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids and docs.count() == len(now) <= before
        ids, before = now, len(now)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    whole = corpus_pipeline.run(spark, sf).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, pieces)) == sorted(map(key, whole)) and {r.doc_id for r in whole} == ids


def test_stages_take_odd_rows(spark, nasty, nothing, sf):
    ids = {r.doc_id for r in nasty.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, nasty, sf)
        assert name == "best_fit_packing" or out.columns == nasty.columns
        # texts without words have no copies or hits; of texts that the rules reject none is left
        left = {r.doc_id for r in out.select("doc_id").collect()}
        assert left <= ids and (left >= {7, 12} if name != "simhash_near_dedup" else {7, 8} & left and {12, 13} & left)
        assert name != "quality_rules" or not left & {None, 0, 1, 2, 3, 11}
        assert stage(spark, nothing, sf).count() == 0


def test_every_stage_equals_brute_force(spark, sf, duck):
    """The rows of run(), by SQL, loops over all lines, pairs and windows, and plain tokenization."""
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from lodestone.llm.tokens import default_tokenizer
    from test_native import brute
    from test_near import plain_kept
    from test_shingles import roots

    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    kept = {r[0] for r in duck.sql(f"select doc_id from ({ORACLES['op10_quality_rules']}) x where kept").fetchall()}
    rows = sorted((d, t) for d, t in texts.items() if d in kept)
    rows = [(d, t) for d, t, n, k in plain_kept(rows) if k or not n]
    assert len(rows) < len(kept)
    top = roots([t for _, t in rows])
    rows = [x for i, x in enumerate(rows) if top[i] == i]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").cast("string"), "text").collect()]
    bad = {d for d, n, hit, *_ in brute(rows, items) if hit and 20 * hit >= n}
    rows = [(d, t) for d, t in rows if d not in bad]
    assert bad
    tokenizer, want = Tokenizer.from_file(default_tokenizer()), []
    for d, t in rows:
        ids = np.asarray(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want += [(d, k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)


def test_exact_copies_leave_one(spark, sf):
    text = "\n".join(f"the {hashlib.md5(str(i).encode()).hexdigest()} of and to {i} house river" for i in range(30))
    docs = spark.createDataFrame([(i, text) for i in range(5)] + [(9, text.replace("house", "horse", 1))], "doc_id long, text string")
    stages = dict(corpus_pipeline.STAGES)
    assert [r.doc_id for r in stages["line_dedup"](spark, docs, sf).collect()] == [0]
    assert [r.doc_id for r in stages["simhash_near_dedup"](spark, docs, sf).collect()] == [0]
