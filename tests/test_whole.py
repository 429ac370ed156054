"""Queries that do the whole job: whole texts, and every vector of the stated query set."""

from pyspark.sql import functions as F

from lodestone import catalogue
from lodestone.catalogue import QUERIES


def test_every_50th_vector_is_asked_against_all(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = {r.vec_id for r in e.filter("vec_id % 50 = 0").collect()}
    n = e.count()
    for name, each in (("cosine_exact", n), ("semantic_pool", min(n, 50))):
        got = {r.qid: r.n for r in QUERIES[name](spark, sf).groupBy("qid").agg(F.count("*").alias("n")).collect()}
        assert got == dict.fromkeys(want, each)


def test_keywordish_sees_the_end_of_a_turn(spark, tmp_path):
    start = "please tell me about the long river and the old house by the "
    rows = [(1, 1, start + "sea"), (2, 1, start + "model_v2"), (3, 1, start + "NASA")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.query, r.keywordish) for r in QUERIES["keywordish"](spark, str(tmp_path)).collect()}
    assert got == {1: (rows[0][2], False), 2: (rows[1][2], True), 3: (rows[2][2], True)}


def test_whole_texts_are_asked(spark, sf):
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    assert {r.qid: r.query for r in catalogue.asked(spark, sf).collect()} == texts
    assert not [n for n, sql in catalogue.ORACLES.items() if "[1:8]" in sql or n.endswith("_whole")]


def test_golden_items_are_those_of_a_plain_search(spark, sf):
    found = {r.query_id: r.expected_path for r in catalogue.golden(spark, sf).collect()}
    docs = [(r.path, r.content) for r in catalogue.docs(spark, sf).collect()]
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = {i.item_id: min(p for p, c in docs if i.text in c) for i in items if any(i.text in c for _, c in docs)}
    assert found == want and want
