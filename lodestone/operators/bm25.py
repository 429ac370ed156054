"""BM25 over chunks, rolled up to documents, for batches of queries (qid, query).

Query words meet postings in an equi-join on (collection, term), so only the postings of query words
count; the words of a block of queries are broadcast, postings stay where they are, and what is shuffled is a sum
for each task, query and chunk, which goes before the next block. Scores are rounded to DIGITS before any
ranking, so the order in which partial sums arrive cannot change a rank; ties go by path and
chunk. Ranks are taken per (query, collection): collections are separate indexes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import documents as D
from lodestone.functions import lexical as X
from lodestone.operators.filters import Filters, clamp
from lodestone.operators.index import KEY, Index, terms
from lodestone.runtime import discard, release, written

DIGITS = 9
MOST_WORDS, LEAST_ROWS = 1 << 18, 1 << 24
# Products of rounded scores and short factors often lie halfway between two roundings, where engines differ;
# moved by this much they never do.
NUDGE = 2e-11
# Fixed values of document ranking.
OVERSAMPLE, LEAST_POOL, MOST_POOL = 25, 200, 500
SUPPORT_CHUNKS, SUPPORT_GAIN = 3, 0.3
METADATA_GAIN, METADATA_CAP = 4.0, 1.5
NAME_COVERAGE, NAME_GAIN = 0.6, 3.0
HUBS, HUB_FACTOR = ("index.md", "log.md", "changelog.md"), 0.4
REPLACED, REPLACED_FACTOR = ("superseded", "deprecated"), 0.7
WEAK_LOG_FACTOR, WEAK_OVERLAP = 0.72, 0.20


def pool_size(n: int) -> int:
    return min(max(n * OVERSAMPLE, LEAST_POOL), MOST_POOL)


def query_words(index: Index, queries: DataFrame) -> DataFrame:
    """(qid, term, times) of the analyzed query."""
    return terms(queries, F.col("query"), ("qid",), index.stem).select("qid", "term", F.col("tf").alias("times"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def blocks(index: Index, queries: DataFrame) -> list[DataFrame]:
    """(qid, collection, term, avgdl, weight, df) of the query words that the index has, in blocks of queries: some
    MOST_WORDS rows each, that meet at most half as many postings as the chunks have words (or LEAST_ROWS)."""
    words = query_words(index, queries).join(index.term_df, "term").join(index.stats, "collection")
    words = words.select("qid", "collection", "term", "avgdl", (F.col("times") * idf(F.col("n"), F.col("df"))).alias("weight"), "df")
    words = written(words, "words")
    release(words.sparkSession)
    rows, met = words.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
    total = index.stats.agg(F.coalesce(F.sum(F.col("n") * F.col("avgdl")), F.lit(0.0))).first()[0]
    n = max(-(-rows // MOST_WORDS), int(-(-met // max(LEAST_ROWS, total / 2))))
    block = F.pmod(F.xxhash64("qid"), F.lit(n))
    return [words.filter(block == i) for i in range(n)] if n > 1 else [words]


def sums(index: Index, words: DataFrame) -> DataFrame:
    """Scores of the queries of a block. Its words go to the postings, which lie by chunks or terms."""
    tf = F.col("tf").cast("double")
    part = F.col("weight") * tf / (tf + index.k1 * (1 - index.b + index.b * F.col("dl") / F.col("avgdl")))
    hits = index.postings.join(F.broadcast(words.drop("df")), ["collection", "term"])
    return hits.groupBy("qid", "collection", "path", "chunk_index").agg(F.round(F.sum(part), DIGITS).alias("score"))


def chunk_scores(index: Index, queries: DataFrame) -> DataFrame:
    """(qid, collection, path, chunk_index, score) of every chunk with a query word."""
    return reduce(DataFrame.union, [sums(index, words) for words in blocks(index, queries)])


def mask(index: Index, scored: DataFrame, filters: Filters) -> DataFrame:
    """Scored rows of chunks that pass the filters; scores and statistics are as without."""
    if filters.empty:
        return scored
    kept = index.chunks.filter(filters.predicate()).select("collection", "path", "chunk_index")
    return scored.join(kept, ["collection", "path", "chunk_index"], "left_semi")


def pool(scored: DataFrame, size: int) -> DataFrame:
    """The best chunks of each query and collection, with pool_rank."""
    w = Window.partitionBy("qid", "collection").orderBy(F.desc("score"), "path", "chunk_index")
    return scored.filter("score > 0").withColumn("pool_rank", F.row_number().over(w)).filter(F.col("pool_rank") <= size)


def metadata_terms() -> Column:
    parts = ("title", "path", "breadcrumb", "folder", "aliases")
    return F.array_distinct(F.concat(*(X.rank_terms(F.coalesce(F.col(c), F.lit(""))) for c in parts)))


def page_names() -> Column:
    """Term sets of the title and each alias."""
    names = F.concat(F.array("title"), F.split(F.coalesce("aliases", F.lit("")), ";"))
    return F.filter(F.transform(names, lambda n: X.rank_terms(n, True)), lambda t: F.size(t) > 0)


def overlap(q: Column, terms_: Column) -> Column:
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, terms_)) / F.size(q))


def names_page(q: Column, names: Column) -> Column:
    return (F.size(q) > 0) & F.exists(names, lambda n: (F.size(F.array_except(q, n)) == 0) & (F.size(q) / F.size(n) >= NAME_COVERAGE))


def covers(q: Column, terms_: Column) -> Column:
    return (F.size(q) > 0) & (F.size(F.array_except(q, terms_)) == 0)


def is_hub(path: Column) -> Column:
    return F.lower(D.basename(path)).isin(*HUBS)


def status_factor(status: Column) -> Column:
    return F.when(F.coalesce(status.isin(*REPLACED), F.lit(False)), F.lit(REPLACED_FACTOR)).otherwise(F.lit(1.0))


def anchored(index: Index, pooled: DataFrame, queries: DataFrame) -> DataFrame:
    """Pooled chunks with the lexical evidence of their metadata and text."""
    q = queries.select("qid", X.rank_terms(F.col("query"), True).alias("q"))
    facts = described(index, pooled).drop("path_terms")
    rows = pooled.join(facts, ["collection", "path", "chunk_index"]).join(q, "qid")
    return rows.withColumns(
        {
            "overlap": overlap(F.col("q"), F.col("meta_terms")),
            "names_query": names_page(F.col("q"), F.col("name_terms")),
            "covers_query": covers(F.col("q"), F.col("content_terms")),
        }
    ).drop("meta_terms", "name_terms", "content_terms")


def rank_facts(chunks: DataFrame) -> DataFrame:
    """What ranking needs of a chunk besides its words: status and terms of its text, path, names and metadata."""
    return chunks.select(
        *KEY, "status", X.rank_terms(F.col("text")).alias("content_terms"), page_names().alias("name_terms"),
        X.rank_terms(F.col("path")).alias("path_terms"), metadata_terms().alias("meta_terms"),
    )


def described(index: Index, pooled: DataFrame) -> DataFrame:
    """rank_facts of the chunks that any query pooled: as published, else each chunk's taken once, however many queries have it."""
    wanted = pooled.select(*KEY).distinct()
    if index.facts is not None:
        return index.facts.join(wanted, list(KEY), "left_semi")
    return rank_facts(index.chunks.join(wanted, list(KEY), "left_semi"))


def file_score(best: Column, scores: Column, overlap_: Column, names: Column, hub: Column, factor: Column) -> Column:
    """Best chunk, plus support by its document's next chunks, metadata and name; scores descend."""
    ratio = F.aggregate(F.slice(scores, 2, SUPPORT_CHUNKS), F.lit(0.0), lambda a, s: a + s / best)
    score = best + SUPPORT_GAIN * best * (ratio / (1.0 + ratio)) + best * F.least(F.lit(METADATA_CAP), METADATA_GAIN * overlap_)
    score = F.when(names, score + best * NAME_GAIN).when(hub, score * HUB_FACTOR).otherwise(score)
    return F.when(best <= 0, best).otherwise(score * factor)


def rollup(rows: DataFrame) -> DataFrame:
    """One row per query and document: its best chunk and the evidence of all pooled ones."""
    keys = ("qid", "collection", "path")
    first = F.struct("pool_rank", "chunk_index", "score", "names_query", "status")
    docs = rows.groupBy(*keys).agg(
        F.min(first).alias("first"), F.max("overlap").alias("overlap"), F.max("covers_query").alias("covers_query"),
        # at most MOST_POOL scores
        F.reverse(F.array_sort(F.collect_list("score"))).alias("scores"), F.count("*").alias("support"),
    )
    best = F.col("first.score")
    score = file_score(best, F.col("scores"), F.col("overlap"), F.col("first.names_query"), is_hub(F.col("path")), status_factor(F.col("first.status")))
    return docs.select(
        *keys, F.col("first.pool_rank").alias("pool_rank"), F.col("first.chunk_index").alias("chunk_index"), best.alias("chunk_score"),
        F.round(score + NUDGE, DIGITS).alias("score"), "support", "overlap", "covers_query", F.col("first.names_query").alias("names_query"),
    )


def weak_score(n: Column) -> Column:
    return F.greatest(F.lit(1.0), WEAK_LOG_FACTOR * F.log(F.greatest(n, F.lit(2)).cast("double")))


def abstain(index: Index, docs: DataFrame) -> DataFrame:
    """Drop weak documents that neither their metadata nor a whole match anchors."""
    rows = docs.join(index.stats.select("collection", "n"), "collection")
    return rows.filter((F.col("score") >= weak_score(F.col("n"))) | (F.col("overlap") >= WEAK_OVERLAP) | F.col("covers_query")).drop("n")


def ranked(docs: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("qid", "collection").orderBy(F.desc("score"), "pool_rank")
    return docs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def evidence(index: Index, queries: DataFrame, n: int, filters: Filters = Filters()) -> DataFrame:
    """The pooled chunks, with evidence, that the best n documents of each query and collection are made from."""
    asked = queries.filter(D.strip(F.col("query")) != "")
    pools = []
    for words in blocks(index, asked):
        # written, as the pool is read twice, and the sums of a block go before those of the next
        pools.append(written(pool(mask(index, sums(index, words), filters), pool_size(n)), "pool"))
        release(words.sparkSession)
    found = written(anchored(index, reduce(DataFrame.union, pools), asked), "evidence")
    for p in pools:
        discard(p)
    release(found.sparkSession)
    return found


def best_documents(index: Index, rows: DataFrame, n: int, filters: Filters = Filters()) -> DataFrame:
    """The best n documents from rows of evidence() for n or more."""
    docs = rollup(rows.filter(F.col("pool_rank") <= pool_size(n)))
    return ranked(abstain(index, docs) if filters.empty else docs, n)


def keyword_search(index: Index, queries: DataFrame, n: int = 20, filters: Filters = Filters()) -> DataFrame:
    """Documents per query and collection, best first: rank, score, best chunk and evidence."""
    n = clamp(n, 20)
    return best_documents(index, evidence(index, queries, n, filters), n, filters)
