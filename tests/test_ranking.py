import math
from datetime import datetime, timezone

import pytest

from lodestone.operators import bm25, filters, fusion, semantic
from lodestone.operators import index as I
from lodestone.settings import OperationError
from pyspark.sql import functions as F

CHUNK = "collection string, path string, chunk_index int, chunk_count int, chunk_id string, title string, folder string, breadcrumb string, extension string, source_mtime double, aliases string, status string, as_of string, piece string, text string"


def chunks(spark, rows):
    """rows: (path, text, title, aliases, status)."""
    out = []
    seen = {}
    for path, text, title, aliases, status in rows:
        i = seen[path] = seen.get(path, -1) + 1
        out.append(("c", path, i, 1, f"{path}::{i}", title, path.split("/")[0] if "/" in path else "", title, path[path.rfind(".") :], 10.0 * len(out), aliases, status, None, text, text))
    return spark.createDataFrame(out, CHUNK)


def queries(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "qid long, query string")


def score(spark, best, scores, overlap=0.0, names=False, hub=False, factor=1.0):
    row = spark.createDataFrame([(best, scores, overlap, names, hub, factor)], "b double, s array<double>, o double, n boolean, h boolean, f double")
    return row.select(bm25.file_score(*(F.col(c) for c in "bsonhf"))).first()[0]


def test_file_score_by_hand(spark):
    assert score(spark, 4.0, [4.0]) == 4.0
    r = (3 + 2 + 1) / 4
    assert score(spark, 4.0, [4.0, 3.0, 2.0, 1.0, 1.0]) == pytest.approx(4 + 0.3 * 4 * r / (1 + r))
    assert score(spark, 4.0, [4.0], overlap=0.25) == 8.0
    assert score(spark, 4.0, [4.0], overlap=1.0) == 10.0
    assert score(spark, 4.0, [4.0], hub=True) == pytest.approx(1.6)
    assert score(spark, 4.0, [4.0], names=True, hub=True) == 16.0
    assert score(spark, 4.0, [4.0], factor=0.7) == pytest.approx(2.8)
    assert score(spark, 0.0, [0.0], names=True) == 0.0


def test_pool_sizes():
    assert [bm25.pool_size(n) for n in (1, 8, 10, 20, 100)] == [200, 200, 250, 500, 500]


def test_bm25_formula(spark):
    made = I.build(chunks(spark, [("a.md", "cat cat dog", "A", "", None), ("b.md", "dog bird fish fish", "B", "", None), ("d.md", "fish", "D", "", None)]))
    got = {(r.qid, r.path): r.score for r in bm25.chunk_scores(made, queries(spark, "cat", "dog dog")).collect()}
    avg = 8 / 3
    w = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    part = lambda tf, dl: tf / (tf + 1.2 * (0.5 + 0.5 * dl / avg))
    assert got[(0, "a.md")] == pytest.approx(w(1) * part(2, 3), abs=1e-8)
    assert got[(1, "b.md")] == pytest.approx(2 * w(2) * part(1, 4), abs=1e-8)
    assert set(got) == {(0, "a.md"), (1, "a.md"), (1, "b.md")}


def test_filters_mask_rows_and_not_statistics(spark):
    rows = [(f"p{i}/x.md", "needle " + "hay " * i, f"T{i}", "", None) for i in range(6)]
    made = I.build(chunks(spark, rows))
    q = queries(spark, "needle")
    whole = {r.path: r.chunk_score for r in bm25.keyword_search(made, q, 10).collect()}
    some = {r.path: r.chunk_score for r in bm25.keyword_search(made, q, 10, filters.parse(path_prefix=["p1", "p2"])).collect()}
    assert set(some) == {"p1/x.md", "p2/x.md"} and all(whole[p] == s for p, s in some.items())


def test_named_page_beats_longer_pages_and_hub_falls(spark):
    rows = [("a/tools.md", "hobby builds", "Tools", "hobby builds", None), ("a/long.md", "hobby builds hobby builds hobby builds text", "Long", "", None),
            ("a/index.md", "hobby builds hobby builds hobby builds text", "Long", "", None)] + [(f"f{i}.md", "filler words here", "F", "", None) for i in range(30)]
    got = [r.path for r in bm25.keyword_search(I.build(chunks(spark, rows)), queries(spark, "hobby builds"), 5).orderBy("rank").collect()]
    assert got == ["a/tools.md", "a/long.md", "a/index.md"]


def test_replaced_pages_rank_below(spark):
    rows = [("old.md", "deploy guide steps", "Guide", "", "superseded"), ("new.md", "deploy guide steps", "Guide", "", None)] + [(f"f{i}.md", "filler", "F", "", None) for i in range(20)]
    got = [r.path for r in bm25.keyword_search(I.build(chunks(spark, rows)), queries(spark, "deploy steps"), 5).orderBy("rank").collect()]
    assert got == ["new.md", "old.md"]


def test_weak_hits_are_dropped_without_filters_only(spark):
    rows = [(f"f{i}.md", "common words and rare" if i == 0 else "common words", "F", "", None) for i in range(50)]
    made = I.build(chunks(spark, rows))
    q = queries(spark, "common zebra")
    assert bm25.keyword_search(made, q, 5).count() == 0
    assert bm25.keyword_search(made, q, 5, filters.parse(extension="md")).count() == 5


def test_blank_and_empty(spark):
    made = I.build(chunks(spark, [("a.md", "x1 y1", "A", "", None)]))
    assert bm25.keyword_search(made, queries(spark, "", "  \n")).count() == 0
    none = I.build(chunks(spark, [("a.md", "x", "A", "", None)]).limit(0))
    assert bm25.keyword_search(none, queries(spark, "x1")).count() == 0


def hits(spark, rows):
    return spark.createDataFrame([(0, "c", p, i, r, s) for r, (p, i, s) in enumerate(rows, 1)], "qid long, collection string, path string, chunk_index int, rank int, score double")


def test_rrf_counts_distinct_documents(spark):
    a = hits(spark, [("a", 0, 9.0), ("b", 0, 8.0)])
    b = hits(spark, [("b", 1, 0.9), ("b", 2, 0.8), ("z", 0, 0.7)])
    got = {r.path: (r.rank, r.rrf, r.chunk_index) for r in fusion.rrf(a, b, 10).collect()}
    assert got["b"][0] == 1 and got["b"][1] == pytest.approx(0.6 / 62 + 0.4 / 61, abs=1e-9) and got["b"][2] == 0
    assert got["z"][1] == pytest.approx(0.4 / 62, abs=1e-9) and got["a"][1] == pytest.approx(0.6 / 61, abs=1e-9)
    scaled = fusion.rrf(a.withColumn("score", F.col("score") * 100), b, 10)
    assert {r.path: r.rank for r in scaled.collect()} == {p: v[0] for p, v in got.items()}


def test_routes(spark):
    made = I.build(chunks(spark, [("a.md", "x1", "A", "", None)]))
    q = queries(spark, "", "zebra", "explain how the zebra came to be in the zoo", "one", "two", "three")
    kw = spark.createDataFrame(
        [(3, "c", "a", 0, 1, 5.0), (4, "c", "a", 0, 1, 5.0), (4, "c", "b", 0, 2, 1.0), (5, "c", "a", 0, 1, 5.0), (5, "c", "b", 0, 2, 4.5)],
        "qid long, collection string, path string, chunk_index int, rank int, score double",
    )
    hy = spark.createDataFrame([(2, "c", 1, 0.39)], "qid long, collection string, rank int, score double")
    got = {r.qid: (r.strategy, r.reason, r.answered) for r in fusion.routes(made, q, kw, hy).collect()}
    assert got[0] == ("keyword", "empty query", False)
    assert got[1] == ("keyword", "keyword query had no meaningful BM25 hits", False)
    assert got[2] == ("hybrid", "hybrid fallback confidence was too low", False)
    assert got[3] == ("hybrid", "BM25 matched only one document", True)
    assert got[4] == ("keyword", "BM25 top hit leads the runner-up 5.00x", True)
    assert got[5] == ("hybrid", "no dominant BM25 hit (top leads runner-up 1.11x)", True)
    sure = fusion.routes(made, q, kw, hy.withColumn("score", F.lit(0.4)), filters.Filters())
    assert {r.qid: r.answered for r in sure.collect()}[2]


def test_collections_merge_by_rank_alone(spark):
    h = spark.createDataFrame([(0, "b", "x", 1, 100.0), (0, "b", "y", 2, 99.0), (0, "a", "z", 1, 0.1)], "qid long, collection string, path string, rank int, score double")
    got = [(r.collection, r.path) for r in fusion.merge_collections(h, ["a", "b"], 2).orderBy("merged_rank").collect()]
    assert got == [("a", "z"), ("b", "x")]


def test_vectors(spark):
    rows = [("c", f"p{i}", 0, v) for i, v in enumerate([[1.0, 0.0], [0.0, 2.0], [3.0, 3.0], [0.0, 0.0]])]
    v = spark.createDataFrame(rows, "collection string, path string, chunk_index int, embedding array<float>")
    q = spark.createDataFrame([(7, [0.0, 5.0]), (8, [0.0, 0.0])], "qid long, embedding array<float>")
    got = {(r.qid, r.path): r.cosine for r in semantic.cosine_pool(v, q, 3).collect()}
    assert got[(7, "p1")] == pytest.approx(1) and got[(7, "p2")] == pytest.approx(0.5**0.5) and len([k for k in got if k[0] == 7]) == 3
    assert semantic.cosine_pool(v, q.limit(0), 3).count() == 0


def test_backend_shape_is_checked(spark):
    class Broken:
        model_name, dim = "broken", 4

        def encode(self, texts):
            import numpy as np

            return np.full((len(texts), 3), 1.0)

    with pytest.raises(Exception, match="vectors of shape"):
        semantic.embed(spark.createDataFrame([("a",)], "t string"), "t", Broken).collect()


def test_hashed_backend_is_the_same_in_both_forms(spark):
    rows = spark.createDataFrame([("The cat and the Cat_2 été",), ("",)], "t string")
    a = [r["embedding"] for r in semantic.embed(rows, "t", semantic.HashedBackend).collect()]
    b = [r[0] for r in rows.select(semantic.hashed_counts(F.col("t"))).collect()]
    assert a == b and sum(a[0]) == 3


@pytest.mark.parametrize("bad", [0, 101, True, "5", 2.0])
def test_limits(bad):
    with pytest.raises(OperationError):
        filters.checked_limit(bad)


def test_filter_parsing():
    f = filters.parse(path_prefix="a/", extension=["MD, py", ".ts"], since="2024-01-01T00:00:00")
    assert f.extensions == (".md", ".py", ".ts") and f.since == datetime(2024, 1, 1, tzinfo=timezone.utc)
    assert filters.parse().empty and filters.parse(path_prefix="", since=" ").empty
    for kw in ({"extension": "md,,py"}, {"extension": "."}, {"since": "soon"}, {"path_prefix": [1]}):
        with pytest.raises(ValueError):
            filters.parse(**kw)
    assert "a/" in f.describe()
    assert [filters.clamp(n) for n in (0, 5, 500)] == [10, 5, 100]


def test_snippets_are_those_of_a_plain_loop(spark):
    import random

    from lodestone.operators import presentation

    r = random.Random(4)
    rows = []
    for q in range(30):
        for rank in range(1, r.choice([2, 8, 25])):
            quote = r.choice(["a", "b", "c", "d", None])
            rows.append((q, rank, r.choice(["x", "y"]), f"p{r.randrange(6)}", quote, quote))
    df = spark.createDataFrame(rows, "qid long, rank int, collection string, path string, quote string, quote_key string")
    for documents, each in ((5, 2), (1, 3), (3, 1)):
        want = {}
        for q in range(30):
            groups = {}
            for x in rows:
                if x[0] == q:
                    groups.setdefault((x[2], x[3]), []).append(x)
            shown = list(groups.items())[:documents]
            told = set()
            for no, (_, hits) in enumerate(shown, 1):
                here = []
                for x in hits:
                    fresh = x[4] and x[5] not in here and not (len(shown) > 1 and (x[2], x[5]) in told)
                    if fresh and len(here) < each:
                        here.append(x[5])
                        told.add((x[2], x[5]))
                        want[q, x[1]] = (no, len(here))
                    else:
                        want[q, x[1]] = (no, None)
        got = {(x.qid, x.rank): (x.doc_no, x.snippet) for x in presentation.snippets(df, documents, each).collect()}
        assert got == want


def test_scores_do_not_depend_on_blocks_of_queries(spark, monkeypatch):
    made = I.build(chunks(spark, [(f"{i}.md", f"cat w{i} " + "dog " * (i % 4), "A", "", None) for i in range(40)]))
    q = queries(spark, *(f"cat w{i} dog dog" for i in range(30)), "cat", "none of them")
    rows = lambda df: sorted(map(tuple, df.collect()))
    scores, found = rows(bm25.chunk_scores(made, q)), rows(bm25.keyword_search(made, q, 5))
    assert len(bm25.blocks(made, q)) == 1
    monkeypatch.setattr(bm25, "MOST_WORDS", 25)
    assert len(bm25.blocks(made, q)) == 4
    assert rows(bm25.chunk_scores(made, q)) == scores and rows(bm25.keyword_search(made, q, 5)) == found
    monkeypatch.setattr(bm25, "MOST_WORDS", 1 << 18)
    monkeypatch.setattr(bm25, "LEAST_ROWS", 1)
    assert len(bm25.blocks(made, q)) > 4 and rows(bm25.keyword_search(made, q, 5)) == found


def test_postings_are_counted_in_their_row(spark):
    rows = [("a.md", "b a b", "A", "", None), ("b.md", "", "B", "", None), ("c.md", "the of", "C", "", None), ("d.md", "Zwei zwei drei é1 é1 é1", "D", "", None)]
    made = chunks(spark, rows).repartition(2).withColumn("text", F.when(F.col("path") == "b.md", F.lit(None)).otherwise(F.col("text")))
    key = ["path", "term", "tf", "dl"]
    counted = I._postings(made, False)
    assert sorted(map(tuple, counted.select(key).collect())) == sorted(map(tuple, I.terms(made, F.col("text"), I.KEY, False).select(key).collect()))
    assert "Exchange hashpartitioning" not in counted._jdf.queryExecution().executedPlan().toString()


def test_query_words_go_to_the_postings(spark):
    """Postings stay where they are: the join with query words broadcasts these, of whatever size."""
    made = I.build(chunks(spark, [(f"{i}.md", f"cat w{i}", "A", "", None) for i in range(5)]))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = bm25.chunk_scores(made, queries(spark, "cat w1"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
