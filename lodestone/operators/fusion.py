"""Rank fusion, hybrid and adaptive search, and merging of collections, for batches of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import documents as D
from lodestone.functions import lexical as X
from lodestone.operators.bm25 import best_documents, evidence, keyword_search
from lodestone.operators.filters import Filters, clamp
from lodestone.operators.index import Index
from lodestone.operators.semantic import semantic_search
from lodestone.runtime import written

DIGITS = 12
# Fixed values.
RRF_K, SEMANTIC_WEIGHT, DOMINANCE, LEAST_CONFIDENCE = 60, 0.4, 1.3, 0.40


def distinct_documents(hits: DataFrame) -> DataFrame:
    """First hit of each document, with doc_rank: its place among distinct documents."""
    first = Window.partitionBy("qid", "collection", "path").orderBy("rank")
    once = hits.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return once.withColumn("doc_rank", F.row_number().over(Window.partitionBy("qid", "collection").orderBy("rank")))


def rrf(keyword: DataFrame, semantic: DataFrame, limit: int, weight: float = SEMANTIC_WEIGHT) -> DataFrame:
    """Fused documents: sums of w / (60 + doc_rank). The hit comes from the keyword list where it has the
    document; ties keep keyword order, then semantic order."""
    keys = ["qid", "collection", "path"]
    a = distinct_documents(keyword).select(*keys, F.col("doc_rank").alias("k_rank"), F.col("chunk_index").alias("k_chunk"), F.col("score").alias("k_score"))
    b = distinct_documents(semantic).select(*keys, F.col("doc_rank").alias("s_rank"), F.col("chunk_index").alias("s_chunk"), F.col("score").alias("s_score"))

    def part(w: float, r: str) -> Column:
        return F.coalesce(F.lit(w) / (RRF_K + F.col(r)), F.lit(0.0))

    both = a.join(b, keys, "full_outer").withColumn("rrf", F.round(part(1 - weight, "k_rank") + part(weight, "s_rank"), DIGITS))
    order = Window.partitionBy("qid", "collection").orderBy(F.desc("rrf"), F.asc_nulls_last("k_rank"), "s_rank")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select(
        *keys, F.coalesce("k_chunk", "s_chunk").alias("chunk_index"), "rank", "rrf", F.coalesce("k_score", "s_score").alias("score")
    )


def hybrid_search(index: Index, queries: DataFrame, top_k: int = 10, filters: Filters = Filters(), weight: float = SEMANTIC_WEIGHT) -> DataFrame:
    top_k = clamp(top_k)
    return fused(index, queries, keyword_search(index, queries, clamp(2 * top_k, 20), filters), top_k, filters, weight)


def fused(index: Index, queries: DataFrame, keyword: DataFrame, top_k: int, filters: Filters = Filters(), weight: float = SEMANTIC_WEIGHT) -> DataFrame:
    """keyword, twice as deep as asked for, fused with a semantic search as deep again."""
    semantic = semantic_search(index, queries, 4 * top_k, filters)
    return rrf(keyword, semantic, 2 * top_k, weight).filter(F.col("rank") <= top_k)


def margins(keyword: DataFrame) -> DataFrame:
    """(qid, collection, hits, margin): how far the best document leads; null with fewer than two."""
    top = keyword.groupBy("qid", "collection").agg(
        F.count("*").alias("hits"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second")
    )
    margin = F.when(F.col("second") > 0, F.col("best") / F.col("second")).when(F.col("second").isNotNull(), F.lit(float("inf")))
    return top.select("qid", "collection", "hits", margin.alias("margin"))


def _decided(index: Index, queries: DataFrame, keyword: DataFrame) -> DataFrame:
    """Every query and collection with what the keyword list alone settles: blank, lost or strong."""
    pairs = queries.select("qid", "query").join(index.stats.select("collection"))
    rows = pairs.join(margins(keyword), ["qid", "collection"], "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))
    return rows.withColumns(
        {
            "blank": D.strip(F.col("query")) == "",
            "strong": F.coalesce(F.col("margin") >= DOMINANCE, F.lit(False)),
            "lost": (F.col("hits") == 0) & X.keywordish(F.col("query")),
        }
    )


def routes(index: Index, queries: DataFrame, keyword: DataFrame, hybrid: DataFrame | None, filters: Filters = Filters()) -> DataFrame:
    """(qid, collection, strategy, reason, fallback_used, answered) of every query and collection."""
    rows = _decided(index, queries, keyword)
    if hybrid is not None:
        tops = hybrid.filter("rank = 1").select("qid", "collection", F.col("score").alias("top"))
        rows = rows.join(tops, ["qid", "collection"], "left")
    else:
        rows = rows.withColumn("top", F.lit(None).cast("double"))
    blank, strong, lost = F.col("blank"), F.col("strong"), F.col("lost")
    timid = (F.col("hits") == 0) & F.lit(filters.empty) & ~F.coalesce(F.col("top") >= LEAST_CONFIDENCE, F.lit(False))
    lead = F.format_string("%.2f", F.col("margin"))
    reason = (
        F.when(blank, "empty query").when(lost, "keyword query had no meaningful BM25 hits")
        .when(strong, F.concat(F.lit("BM25 top hit leads the runner-up "), lead, F.lit("x")))
        .when(timid, "hybrid fallback confidence was too low")
        .when(F.col("hits") == 0, "BM25 returned no positive-score results").when(F.col("hits") == 1, "BM25 matched only one document")
        .otherwise(F.concat(F.lit("no dominant BM25 hit (top leads runner-up "), lead, F.lit("x)")))
    )
    keyword_ = blank | lost | strong
    return rows.select(
        "qid", "collection", F.when(keyword_, "keyword").otherwise("hybrid").alias("strategy"), reason.alias("reason"),
        (~keyword_).alias("fallback_used"), (~(blank | lost | (~strong & timid))).alias("answered"),
    )


def adaptive_search(index: Index, queries: DataFrame, top_k: int = 10, filters: Filters = Filters()) -> tuple[DataFrame, DataFrame]:
    """(hits, routes). Keyword results where one document clearly leads, hybrid ones elsewhere.

    Chunks are scored once, as deep as the fusion needs; only queries that their keyword list leaves open are
    searched by vectors."""
    top_k = clamp(top_k)
    first, deep = max(top_k, 2), clamp(2 * top_k, 20)
    pooled = evidence(index, queries, max(first, deep), filters)
    keyword = written(best_documents(index, pooled, first, filters), "keyword")
    keys = ["qid", "collection"]
    undecided = written(_decided(index, queries, keyword).filter("not (blank or strong or lost)").select(*keys), "undecided")
    left = queries.join(undecided.select("qid").distinct(), "qid", "left_semi")
    deeper = best_documents(index, pooled.join(undecided, keys, "left_semi"), deep, filters)
    hybrid = written(fused(index, left, deeper, top_k, filters).join(undecided, keys, "left_semi"), "hybrid")
    route = routes(index, queries, keyword, hybrid, filters)
    chosen = route.filter("answered").select("qid", "collection", "strategy")
    a = keyword.filter(F.col("rank") <= top_k).join(chosen.filter("strategy = 'keyword'"), keys)
    b = hybrid.join(chosen.filter("strategy = 'hybrid'"), keys)
    columns = ("qid", "collection", "path", "chunk_index", "rank")
    none = F.lit(None).cast("double")
    hits = a.select(*columns, "score", none.alias("rrf"), F.col("strategy").alias("source")).unionByName(b.select(*columns, "score", "rrf", F.col("strategy").alias("source")))
    return hits, route


def merge_collections(hits: DataFrame, order: list[str], limit: int) -> DataFrame:
    """One list per query: 1 / (60 + rank in its own collection); ties in the order of registration."""
    place = F.coalesce(*(F.when(F.col("collection") == c, F.lit(i)) for i, c in enumerate(order)), F.lit(len(order)))
    fused = hits.withColumn("fused", F.lit(1.0) / (RRF_K + F.col("rank"))).withColumn("_place", place)
    w = Window.partitionBy("qid").orderBy(F.desc("fused"), "_place", "rank")
    return fused.withColumn("merged_rank", F.row_number().over(w)).filter(F.col("merged_rank") <= limit).drop("_place")


def merge_routes(route: DataFrame) -> DataFrame:
    """Any fallback makes the whole hybrid; distinct reasons are sorted and joined."""
    return route.groupBy("qid").agg(
        F.max("fallback_used").alias("fallback_used"), F.array_join(F.array_sort(F.collect_set("reason")), "; ").alias("reason")
    ).withColumn("strategy", F.when(F.col("fallback_used"), "hybrid").otherwise("keyword"))


def with_hints(index: Index, hits: DataFrame, queries: DataFrame) -> DataFrame:
    """hits with what matched in the title, path, breadcrumb and text; else the score that found them."""
    rows = hits.join(index.chunks, ["collection", "path", "chunk_index"]).join(queries.select("qid", "query"), "qid")
    fields = (("title", "title"), ("path", "path"), ("breadcrumb", "breadcrumb"), ("content", "text"))
    said = [F.concat(F.lit(f"{label} matches: "), F.nullif(X.match_hint(F.col("query"), F.col(c)), F.lit(""))) for label, c in fields]
    hints = F.array_compact(F.array(*said))
    score = F.concat(F.col("source"), F.lit(" retrieval score: "), F.format_string("%.3f", F.coalesce("rrf", "score")))
    alone = F.when(F.col("source").isin("semantic", "hybrid"), F.array(score)).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("match_hints", F.when(F.size(hints) > 0, hints).otherwise(alone))
