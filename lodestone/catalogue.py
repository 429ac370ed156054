"""Registered queries of the retrieval engine, over a corpus derived from the test tables.

`documents` stand in for the files of four collections (by language), `benchmark` for golden queries,
`embeddings` for stored vectors, `labels` for categories. Every ranking takes all queries at once.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone import catalogue_sql as S
from lodestone.functions import documents as D
from lodestone.functions import lexical as X
from lodestone.functions import porter2
from lodestone.operators import bm25 as B
from lodestone.operators import chunking, evaluate, fusion, incremental, presentation, semantic
from lodestone.operators import index as I
from lodestone.operators.filters import Filters, parse
from lodestone.runtime import scratch, table, written
from lodestone.settings import Settings
from lodestone.sources import kb as live
from lodestone.sources import paths, store

Query = Callable[[SparkSession, str], DataFrame]
SPACES = r"[ \t\n\x0B\f\r]+"
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# --- the corpus


def kb(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    text = F.coalesce("text", F.lit(""))
    line = lambda n: F.split_part(text, F.lit("\n"), F.lit(n))
    ext = F.when(F.col("lang") == "en", ".md").when(F.col("lang") == "fr", ".py").when(F.col("lang") == "de", ".sql").otherwise(".yaml")
    title = F.trim(F.substring(line(1), 1, 60))
    name = F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("g"), "doc_id", F.lit("/index"))).otherwise(F.concat(F.lit("d"), "doc_id"))
    return d.select(
        "doc_id", F.coalesce("lang", F.lit("none")).alias("collection"), F.concat("source", F.lit("/"), name, ext).alias("path"), F.col("source").alias("folder"),
        ext.alias("extension"), (F.lit(1704067200) + F.col("doc_id") * 3600).cast("double").alias("mtime"),
        F.concat(F.lit("# "), title, F.lit("\n\n"), text).alias("content"),
        F.when(F.col("doc_id") % 17 == 0, "superseded").alias("status"),
        F.when(F.col("doc_id") % 5 == 0, F.trim(F.substring(line(2), 1, 40))).alias("also"),
    )


def docs(spark: SparkSession, sf: str) -> DataFrame:
    rows = kb(spark, sf).withColumn("title", D.title(F.col("content"), F.col("path")))
    names = D.alias_names(F.lit(""), F.array(F.coalesce("also", F.lit(""))), F.col("title"))
    none = F.lit(None).cast("string")
    return rows.select("doc_id", "collection", "path", "title", D.folder(F.col("path")).alias("folder"), "extension", "mtime", "content", none.alias("summary"), names.alias("aliases"), "status", none.alias("as_of"))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.build_chunks(docs(spark, sf), by="windows")


def index(spark: SparkSession, sf: str, whole: bool = True) -> I.Index:
    """The index of all chunks; pieces are part of their texts, and searches alone need no second copy of them."""
    found = chunks(spark, sf)
    return I.build(written(found if whole else found.drop("piece"), "chunks"))


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """Every benchmark text is a query."""
    return table(spark, sf, "benchmark").select(F.col("item_id").cast("long").alias("qid"), F.col("text").alias("query"))


def vectored(spark: SparkSession, sf: str) -> tuple[I.Index, DataFrame]:
    """Index with vectors, and queries with embeddings."""
    made = index(spark, sf, whole=False)
    vectors = semantic.embed(made.chunks.select(*I.KEY, "text"), "text", semantic.HashedBackend).drop("text")
    return made.with_vectors(vectors), semantic.embed(asked(spark, sf), "query", semantic.HashedBackend)


def r6(c: str | Column) -> Column:
    # only for numbers not rounded yet: two roundings in a row differ between engines at ties
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def mapped(fn: Callable, type_: str):
    """A function of one or two strings as a Pandas UDF."""

    @F.pandas_udf(type_)
    def one(a: pd.Series) -> pd.Series:
        return a.map(fn)

    @F.pandas_udf(type_)
    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([fn(x, y) for x, y in zip(a, b)])

    return lambda *columns: (one if len(columns) == 1 else two)(*columns)


def longs(df: DataFrame) -> DataFrame:
    """Integers as longs, as SQL gives them."""
    return df.select(*(F.col(c).cast("long") if t == "int" else F.col(c) for c, t in df.dtypes))


def joined(c: Column) -> Column:
    return F.array_join(F.array_sort(c), " ")


# --- lexical analysis


@register(f"with {S.KB} select doc_id, array_to_string({S.words('content')}, ' ') as words from docs")
def bm25_tokenize(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(X.words(F.col("content")), " ").alias("words"))


@register(f"with {S.KB} select doc_id, array_to_string(list_sort({S.rank_terms('content')}), ' ') as terms, array_to_string(list_sort({S.rank_terms('content', True)}), ' ') as topical from docs")
def rank_terms(spark, sf):
    c = F.col("content")
    return docs(spark, sf).select("doc_id", joined(X.rank_terms(c)).alias("terms"), joined(X.rank_terms(c, True)).alias("topical"))


@register(f"select word, {S.norm('word')} as term from (select distinct unnest(regexp_extract_all(text, '[A-Za-z0-9_/-]+')) as word from documents) w")
def normalize_rank_term(spark, sf):
    found = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(X.TERM), F.lit(0))).alias("word")).distinct()
    return found.select("word", X.normal_term(F.col("word")).alias("term"))


@register(f"select conv_id, turn, text, array_to_string({S.query_terms('text')}, ' ') as terms from conversations")
def query_terms(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "text", F.array_join(X.query_terms(F.col("text")), " ").alias("terms"))


@register(f"select conv_id, turn, text as query, {S.keywordish('text')} as keywordish from conversations")
def keywordish(spark, sf):
    q = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", q.alias("query"), X.keywordish(q).alias("keywordish"))


@register(f"with {S.KB} select doc_id, {S.trim_boundary('content', 220)} as trimmed from docs")
def trim_boundary(spark, sf):
    return docs(spark, sf).select("doc_id", X.trim_boundary(F.col("content"), 220).alias("trimmed"))


_QUOTE = f"""
quoted as (
  select doc_id, query, c, p, greatest(p - 121, 0) as a, least(length(c), p - 1 + 240) as z
  from (select doc_id, query, c, list_min(list_filter(list_transform({S.query_terms('query')}, lambda t: instr(lower(c), t)), lambda x: x > 0)) as p
        from (select doc_id, {S.compact('content')} as c, title as query from docs) u) v),
quotes as (
  select doc_id, query, case when c = '' then null else {S.trim_boundary("(case when p is null then c else case when a > 0 then '...' else '' end || substr(c, a + 1, z - a) || case when z < length(c) then '...' else '' end end)", 360)} end as quote
  from quoted)"""


@register(f"with {S.KB}, {_QUOTE} select doc_id, quote from quotes")
def best_quote(spark, sf):
    return docs(spark, sf).select("doc_id", X.best_quote(F.col("content"), F.col("title")).alias("quote"))


@register(f"with {S.KB} select doc_id, substr(trim(regexp_replace(lower(content), '[^a-z0-9]+', ' ', 'g')), 1, 220) as near_dup_key from docs")
def near_dup_key(spark, sf):
    return docs(spark, sf).select("doc_id", X.near_dup_key(F.col("content")).alias("near_dup_key"))


@register(f"with {S.KB}, {_QUOTE} select doc_id, array_to_string(list_filter({S.query_terms('query')}, lambda t: contains(lower(quote), t)), ' ') as matched from quotes")
def matched_terms(spark, sf):
    quote = X.best_quote(F.col("content"), F.col("title"))
    return docs(spark, sf).select("doc_id", F.array_join(X.matched_terms(F.col("title"), quote), " ").alias("matched"))


# --- documents and chunks


@register(f"with {S.KB} select doc_id, title from docs")
def extract_title(spark, sf):
    return docs(spark, sf).select("doc_id", "title")


@register(f"with {S.KB} select doc_id, path, split_part(path, '/', 1) as folder from docs")
def folder(spark, sf):
    return docs(spark, sf).select("doc_id", "path", D.folder(F.col("path")).alias("folder"))


@register("select page_id, url, lower(regexp_extract(url, '[^/.][^/]*?([.][^./]+)$', 1)) as extension, lower(regexp_extract(url, '[^/.][^/]*?([.][^./]+)$', 1)) in ('.md', '.sql', '.py', '.ts', '.tsx', '.yml', '.yaml') as supported from pages")
def supported_ext(spark, sf):
    e = D.extension(F.col("url"))
    return table(spark, sf, "pages").select("page_id", "url", e.alias("extension"), e.isin(*D.EXTENSIONS).alias("supported"))


@register("select url, len(list_filter(string_split(url, '/'), lambda p: starts_with(p, '.') or p in ('en', 'drafts'))) = 0 as visible from pages")
def hidden_filter(spark, sf):
    from lodestone.sources.paths import visible

    return table(spark, sf, "pages").select("url", visible(F.col("url"), ("en", "drafts")).alias("visible"))


@register(f"with {S.KB} select doc_id, aliases, case when aliases <> '' then 'Also known as: ' || aliases || chr(10) else '' end as lead from docs")
def document_card(spark, sf):
    return docs(spark, sf).select("doc_id", "aliases", D.card(F.col("aliases"), F.col("summary")).alias("lead"))


@register(f"with {S.CHUNKS} select path, cast(chunk_index as bigint) as chunk_index, cast(chunk_count as bigint) as chunk_count, path || '::' || chunk_index as chunk_id, piece from ch")
def chunk_windows(spark, sf):
    return longs(chunks(spark, sf).select("path", "chunk_index", "chunk_count", "chunk_id", "piece"))


@register(f"with {S.CHUNKS} select path, cast(chunk_index as bigint) as chunk_index, text from ch")
def contextual_text(spark, sf):
    return longs(chunks(spark, sf).select("path", "chunk_index", "text"))


@register(f"with {S.CHUNKS} select path, cast(chunk_index as bigint) as chunk_index, breadcrumb from ch")
def breadcrumb(spark, sf):
    return longs(chunks(spark, sf).select("path", "chunk_index", "breadcrumb"))


@register(f"with {S.CHUNKS} select collection, path || '::' || chunk_index as chunk_id, text = '' as blank from ch")
def chunk_id(spark, sf):
    return chunks(spark, sf).select("collection", "chunk_id", (F.col("text") == "").alias("blank"))


@register(f"with {S.KB} select path, case when extension = '.md' then title else regexp_replace(list_last(string_split(path, '/')), '[.][^.]+$', '') end as title from docs")
def list_title(spark, sf):
    return docs(spark, sf).select("path", D.listing_title(F.col("content"), F.col("path")).alias("title"))


@register()
def chunk_headings(spark, sf):
    return longs(chunking.build_chunks(docs(spark, sf)).select("path", "chunk_index", "chunk_count", "piece"))


@register()
def stem_en(spark, sf):
    found = docs(spark, sf).select(F.explode(X.words(F.col("content"))).alias("word")).distinct()
    return found.select("word", porter2.stem_column(F.col("word")).alias("stem"))


@register(f"with {S.KB} select doc_id, sha256(content) as content_sha from docs")
def hash_content(spark, sf):
    return docs(spark, sf).select("doc_id", F.sha2(F.col("content").cast("binary"), 256).alias("content_sha"))


# --- the lexical index and BM25


@register(f"with {S.POSTINGS} select collection, path, cast(chunk_index as bigint) as chunk_index, term, tf, dl from post")
def bm25_index(spark, sf):
    return longs(index(spark, sf).postings.select("collection", "path", "chunk_index", "term", "tf", "dl"))


@register(f"with {S.POSTINGS} select collection, term, df from tdf")
def bm25_term_df(spark, sf):
    return index(spark, sf).term_df


@register(f"with {S.POSTINGS} select collection, n, round(avgdl, 6) as avgdl from st")
def bm25_index_stats(spark, sf):
    return index(spark, sf).stats.select("collection", "n", r6("avgdl").alias("avgdl"))


_KEY = "qid, collection, path, cast(chunk_index as bigint) as chunk_index"


@register(f"with {S.SCORED} select {_KEY}, score as score from sc")
def bm25_score(spark, sf):
    return longs(B.chunk_scores(index(spark, sf), asked(spark, sf)))


@register(f"with {S.SCORED}{S.keyword(10)} select {_KEY}, score as score, pool_rank from pool")
def bm25_pool(spark, sf):
    return longs(B.pool(B.chunk_scores(index(spark, sf), asked(spark, sf)), B.pool_size(10)))


_MASK = Filters(("src1", "src2"), (".md", ".py"), datetime.fromtimestamp(1704067200 + 100 * 3600, timezone.utc))
_WHERE = "(starts_with(path, 'src1') or starts_with(path, 'src2')) and extension in ('.md', '.py') and mtime >= 1704427200"


@register(f"with {S.SCORED}{S.keyword(10, '', _WHERE, True)} select {_KEY}, score as score, pool_rank from pool")
def filter_mask(spark, sf):
    made = index(spark, sf)
    return longs(B.pool(B.mask(made, B.chunk_scores(made, asked(spark, sf)), _MASK), B.pool_size(10)))


def _anchored(spark, sf, n=10) -> DataFrame:
    made, q = index(spark, sf), asked(spark, sf)
    return B.anchored(made, B.pool(B.chunk_scores(made, q), B.pool_size(n)), q)


@register(f"with {S.SCORED}{S.keyword(10)} select {_KEY}, round(overlap, 6) as overlap from an")
def metadata_overlap(spark, sf):
    return longs(_anchored(spark, sf).select("qid", *I.KEY, r6("overlap").alias("overlap")))


@register(f"with {S.SCORED}{S.keyword(10)} select {_KEY}, names_query from an")
def names_page(spark, sf):
    return longs(_anchored(spark, sf).select("qid", *I.KEY, "names_query"))


@register(f"with {S.SCORED}{S.keyword(10)} select {_KEY}, covers_query from an")
def covers_query(spark, sf):
    return longs(_anchored(spark, sf).select("qid", *I.KEY, "covers_query"))


@register(f"with {S.SCORED}{S.keyword(10)} select {_KEY}, chunk_score as chunk_score, round(overlap, 6) as overlap, covers_query, support from dr")
def doc_rollup(spark, sf):
    rows = B.rollup(_anchored(spark, sf))
    return longs(rows.select("qid", *I.KEY, F.col("chunk_score").alias("chunk_score"), r6("overlap").alias("overlap"), "covers_query", "support"))


@register(f"with {S.SCORED}{S.keyword(10)} select qid, collection, path, score as file_score from dr")
def file_score(spark, sf):
    return B.rollup(_anchored(spark, sf)).select("qid", "collection", "path", F.col("score").alias("file_score"))


@register(f"with {S.KB} select path, case when lower(list_last(string_split(path, '/'))) in ('index.md', 'log.md', 'changelog.md') then 0.4e0 else 1.0e0 end as factor from docs")
def hub_demotion(spark, sf):
    return docs(spark, sf).select("path", F.when(B.is_hub(F.col("path")), F.lit(B.HUB_FACTOR)).otherwise(F.lit(1.0)).alias("factor"))


@register(f"with {S.KB} select path, case when status in ('superseded', 'deprecated') then 0.7e0 else 1.0e0 end as factor from docs")
def status_factor(spark, sf):
    return docs(spark, sf).select("path", B.status_factor(F.col("status")).alias("factor"))


@register(f"with {S.KB} select path, array_to_string(list_transform(list_filter(list_transform(list_concat([title], string_split(aliases, ';')), lambda x: {S.rank_terms('x', True)}), lambda x: len(x) > 0), lambda x: array_to_string(list_sort(x), ' ')), ' | ') as names from docs")
def page_names(spark, sf):
    return docs(spark, sf).select("path", F.array_join(F.transform(B.page_names(), joined), " | ").alias("names"))


@register(f"with {S.SCORED}{S.keyword(10)} select qid, collection, path, dr.score as score from dr join st using (collection) where dr.score >= greatest(1.0e0, 0.72e0 * ln(greatest(n, 2))) or overlap >= 0.20e0 or covers_query")
def weak_abstain(spark, sf):
    made, q = index(spark, sf), asked(spark, sf)
    rows = B.anchored(made, B.pool(B.chunk_scores(made, q), B.pool_size(10)), q)
    return B.abstain(made, B.rollup(rows)).select("qid", "collection", "path", F.col("score").alias("score"))


_KW = f"select {_KEY}, rank, score as score, chunk_score as chunk_score, support, round(overlap, 6) as overlap from kw"


def _evidence(rows: DataFrame) -> DataFrame:
    return longs(rows.select("qid", *I.KEY, "rank", F.col("score").alias("score"), F.col("chunk_score").alias("chunk_score"), "support", r6("overlap").alias("overlap")))


@register(f"with {S.SCORED}{S.keyword(10)} {_KW}")
def keyword_search(spark, sf):
    return _evidence(B.keyword_search(index(spark, sf), asked(spark, sf), 10))


@register(f"with {S.SCORED}{S.keyword(10, '', _WHERE, True)} {_KW}")
def bm25_filtered(spark, sf):
    return _evidence(B.keyword_search(index(spark, sf), asked(spark, sf), 10, _MASK))


# --- vectors


@register("select vec_id, round(list_sum(list_transform(embedding, lambda x: (x::double / n) * (x::double / n))), 6) as square, round(embedding[1]::double / n, 6) as first from (select *, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as n from embeddings) e")
def normalize_rows(spark, sf):
    v = semantic.normalized(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", r6(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)).alias("square"), r6(F.get(v, F.lit(0))).alias("first"))


_NEAREST = """
qv as (select vec_id as qid, embedding as e from embeddings where vec_id % 50 = 0),
nn as (select qid, vec_id, round(list_sum(list_transform(list_zip(e, embedding), lambda p: p[1]::double * p[2]::double))
    / sqrt(list_sum(list_transform(e, lambda x: x::double * x::double))) / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 9) as cosine
  from qv cross join embeddings)"""


def _vector_table(spark, sf) -> DataFrame:
    key = [F.lit("all").alias("collection"), F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("path"), F.lit(0).alias("chunk_index")]
    return table(spark, sf, "embeddings").select(*key, "embedding")


def _every_50th(spark, sf) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50, asked against all."""
    return table(spark, sf, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")


@register(f"with {_NEAREST} select qid, vec_id, cosine as cosine from nn")
def cosine_exact(spark, sf):
    rows = semantic.cosine_all(_vector_table(spark, sf), _every_50th(spark, sf))
    return rows.select("qid", F.col("path").cast("long").alias("vec_id"), "cosine")


@register(f"with {_NEAREST} select * from (select qid, vec_id, cosine as cosine, row_number() over (partition by qid order by cosine desc, vec_id) as pool_rank from nn) x where pool_rank <= 50")
def semantic_pool(spark, sf):
    rows = semantic.cosine_pool(_vector_table(spark, sf), _every_50th(spark, sf), 50)
    return longs(rows.select("qid", F.col("path").cast("long").alias("vec_id"), F.col("cosine").alias("cosine"), "pool_rank"))


@register(f"with {S.SCORED}{S.SEMANTIC}{S.semantic(50)} select {_KEY}, rank, cosine as score, boost as boost, sort_score as sort_score from sm")
def lexical_boost(spark, sf):
    rows = semantic.semantic_search(*vectored(spark, sf), 50)
    return longs(rows.select("qid", *I.KEY, "rank", F.col("score").alias("score"), F.col("boost").alias("boost"), F.col("sort_score").alias("sort_score")))


@register(f"with {S.SCORED}{S.SEMANTIC}{S.semantic(10)} select {_KEY}, rank, cosine as score from sm")
def semantic_topk(spark, sf):
    return longs(semantic.semantic_search(*vectored(spark, sf), 10).select("qid", *I.KEY, "rank", F.col("score").alias("score")))


# --- fusion and routing

_BASE = f"with {S.SCORED}{S.SEMANTIC}"


@register(f"{_BASE}{S.hybrid(10)} select {_KEY}, rank, rrf from hy")
def rrf_fuse(spark, sf):
    made, q = vectored(spark, sf)
    rows = fusion.rrf(B.keyword_search(made, q, 20), semantic.semantic_search(made, q, 40), 10)
    return longs(rows.select("qid", *I.KEY, "rank", "rrf"))


@register(f"{_BASE}{S.hybrid(5)} select {_KEY}, rank, score as score, rrf from hy")
def hybrid_search(spark, sf):
    rows = fusion.hybrid_search(*vectored(spark, sf), 5)
    return longs(rows.select("qid", *I.KEY, "rank", F.col("score").alias("score"), "rrf"))


@register(f"with {S.SCORED}{S.keyword(5)} select qid, collection, count(*) as hits, round(max(case when rank = 1 then score end) / max(case when rank = 2 then score end), 6) as margin from kw group by all")
def bm25_margin(spark, sf):
    rows = fusion.margins(B.keyword_search(index(spark, sf), asked(spark, sf), 5))
    return rows.select("qid", "collection", "hits", r6("margin").alias("margin"))


@register(f"{_BASE}{S.ADAPTIVE} select qid, collection, case when by_keyword then 'keyword' else 'hybrid' end as strategy, reason, not by_keyword as fallback_used, answered from rt")
def adaptive_route(spark, sf):
    return fusion.adaptive_search(*vectored(spark, sf), 5)[1]


@register(f"{_BASE}{S.ADAPTIVE} select {_KEY}, rank, score as score, rrf, source from ad")
def adaptive_search(spark, sf):
    rows = fusion.adaptive_search(*vectored(spark, sf), 5)[0]
    return longs(rows.select("qid", *I.KEY, "rank", F.col("score").alias("score"), "rrf", "source"))


@register(f"with {S.CHUNKS} select path, cast(chunk_index as bigint) as chunk_index, case when chunk_count > 1 then concat_ws(chr(10) || chr(10), lag(text) over w, lead(text) over w) end as neighbor_content from ch window w as (partition by collection, path order by chunk_index)")
def neighbors(spark, sf):
    return longs(I.neighbors(chunks(spark, sf)).select("path", "chunk_index", "neighbor_content"))


_ORDER = ["en", "fr", "de", "es", "none"]


@register(f"""with {S.SCORED}{S.keyword(5)} select qid, collection, path, merged_rank, round(fused, 9) as fused from (
  select *, 1.0e0 / (60 + rank) as fused, row_number() over (partition by qid order by 1.0e0 / (60 + rank) desc, list_position(['en', 'fr', 'de', 'es', 'none'], collection), rank) as merged_rank from kw) x where merged_rank <= 10""")
def collection_merge(spark, sf):
    rows = fusion.merge_collections(B.keyword_search(index(spark, sf), asked(spark, sf), 5), _ORDER, 10)
    return longs(rows.select("qid", "collection", "path", "merged_rank", F.round("fused", 9).alias("fused")))


@register(f"{_BASE}{S.ADAPTIVE} select qid, bool_or(not by_keyword) as fallback_used, string_agg(distinct reason, '; ' order by reason) as reason, case when bool_or(not by_keyword) then 'hybrid' else 'keyword' end as strategy from rt group by qid")
def route_merge(spark, sf):
    return fusion.merge_routes(fusion.adaptive_search(*vectored(spark, sf), 5)[1])


def _sql_hint(column: str) -> str:
    return f"array_to_string(list_sort(list_distinct(list_filter({S.query_terms('query')}, lambda t: contains(lower({column}), t))))[1:5], ', ')"


_HINTS = " || ".join(f"case when {_sql_hint(c)} <> '' then '{label} matches: ' || {_sql_hint(c)} || '; ' else '' end" for label, c in (("title", "title"), ("path", "path"), ("breadcrumb", "breadcrumb"), ("content", "text")))


@register(f"with {S.SCORED}{S.keyword(5)} select {_KEY}, {_HINTS} as hints from kw join ch using (collection, path, chunk_index) join q using (qid)")
def match_hints(spark, sf):
    made, q = index(spark, sf), asked(spark, sf)
    hits = B.keyword_search(made, q, 5).withColumns({"source": F.lit("keyword"), "rrf": F.lit(None).cast("double")})
    rows = fusion.with_hints(made, hits, q)
    return longs(rows.select("qid", *I.KEY, F.array_join(F.transform("match_hints", lambda h: F.concat(h, F.lit("; "))), "").alias("hints")))


# --- presentation


def _semantic_hits(spark, sf) -> DataFrame:
    return semantic.semantic_search(*vectored(spark, sf), 10)


@register(f"""{_BASE}{S.semantic(10)} select qid, collection, path, cast(chunk_index as bigint) as chunk_index, rank, doc_no from (
  select *, dense_rank() over (partition by qid order by first, collection, path) as doc_no from (select *, min(rank) over (partition by qid, collection, path) as first from sm) x) y where doc_no <= 5""")
def group_by_document(spark, sf):
    return longs(presentation.group_by_document(_semantic_hits(spark, sf), 5).select("qid", *I.KEY, "rank", "doc_no"))


@register(f"""{_BASE}{S.semantic(10)} select * from (select qid, collection, path, row_number() over (partition by qid order by min(rank), collection, path) as followup from sm group by qid, collection, path) x where followup <= 3""")
def followups(spark, sf):
    return longs(presentation.followups(_semantic_hits(spark, sf)))


@register(f"""with {S.KB} select collection, path, case when extension = '.md' then title else regexp_replace(list_last(string_split(path, '/')), '[.][^.]+$', '') end as title, split_part(path, '/', 1) as folder, extension, mtime
  from docs where extension in ('.md', '.sql') order by collection, path limit 100""")
def list_documents(spark, sf):
    return presentation.listing(docs(spark, sf), parse(extension="md,sql"), limit=100)


@register(f"with {S.CHUNKS} select collection, count(*) as chunks, count(distinct path) as documents from ch group by collection")
def index_stats(spark, sf):
    return I.index_stats(chunks(spark, sf))


@register(f"with {S.KB} select kind, name, count(*) as files from (select unnest(['extension', 'capture']) as kind, unnest([extension, case when doc_id % 7 = 0 then 'excluded' when length(content) < 60 then 'empty' else 'captured' end]) as name from docs) x group by all")
def corpus_scan(spark, sf):
    capture = F.when(F.col("doc_id") % 7 == 0, "excluded").when(F.length("content") < 60, "empty").otherwise("captured")
    return presentation.corpus_scan(docs(spark, sf).withColumn("capture", capture))


# --- filters


def _filtered(spark, sf, f: Filters) -> DataFrame:
    return docs(spark, sf).filter(f.predicate(mtime="mtime")).select("collection", "path")


@register(f"with {S.KB} select collection, path from docs where starts_with(path, 'src1/') or starts_with(path, 'src2')")
def filter_path_prefix(spark, sf):
    return _filtered(spark, sf, parse(path_prefix=["src1/", "src2"]))


@register(f"with {S.KB} select collection, path from docs where extension in ('.py', '.sql')")
def filter_extension(spark, sf):
    return _filtered(spark, sf, parse(extension=".PY,sql"))


@register(f"with {S.KB} select collection, path from docs where mtime >= epoch(timestamp '2024-01-10 12:00:00')")
def filter_since(spark, sf):
    return _filtered(spark, sf, parse(since="2024-01-10T12:00:00"))


@register(f"with {S.KB} select collection, path from docs where {_WHERE}")
def filter_and(spark, sf):
    return _filtered(spark, sf, _MASK)


# --- sources and incremental builds


def _prior(spark, sf) -> DataFrame:
    d = docs(spark, sf).filter("doc_id % 11 <> 0")
    content = F.when(F.col("doc_id") % 13 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    return _files(d.withColumn("content", content))


def _files(d: DataFrame) -> DataFrame:
    return d.select("path", "extension", "mtime", F.octet_length("content").cast("long").alias("size"), "content")


_INVENTORIES = """
now as (select path, sha256(content) as sha from docs where doc_id % 10 <> 0),
prior as (select path, sha256(case when doc_id % 13 = 0 then content || '!' else content end) as sha from docs where doc_id % 11 <> 0)"""


@register(f"with {S.KB}, {_INVENTORIES} select coalesce(prior.path, now.path) as path, case when prior.path is null then 'added' when now.path is null then 'removed' when prior.sha = now.sha then 'unchanged' else 'changed' end as change from prior full join now on prior.path = now.path")
def change_detect(spark, sf):
    now = _files(docs(spark, sf).filter("doc_id % 10 <> 0"))
    return incremental.change_detect(incremental.inventory(_prior(spark, sf)), incremental.inventory(now))


@register(f"with {S.KB} select path, extension, mtime, cast(strlen(content) as bigint) as size, sha256(content) as content_sha from docs")
def source_inventory(spark, sf):
    return incremental.inventory(_files(docs(spark, sf)), incremental.inventory(_files(docs(spark, sf).filter("doc_id % 2 = 0"))))


@register(f"with {S.POSTINGS} select collection, term, df from tdf")
def incremental_build(spark, sf):
    """An index of other documents, brought up to date, has the statistics of one made anew."""
    now = docs(spark, sf)
    old = now.filter("doc_id % 11 <> 0").withColumn("content", F.when(F.col("doc_id") % 13 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    prior = I.build(chunking.build_chunks(old, by="windows"))
    changed = incremental.change_detect(incremental.inventory(_files(old)), incremental.inventory(_files(now)))
    return incremental.incremental_build(prior, now, changed, by="windows").term_df


@register(f"with {S.KB}, {_INVENTORIES} select docs.path, title from docs join now using (path) left join prior using (path) where prior.path is null or prior.sha <> now.sha")
def capture_subset(spark, sf):
    wanted = change_detect(spark, sf).filter("change in ('added', 'changed')")
    return docs(spark, sf).join(wanted, "path", "left_semi").select("path", "title")


@register(f"with {S.KB} select collection, path, content from docs where path = 'src7/d7.md' or path = 'src0/g0/index.py' or path = 'src2/d2.md'")
def doc_fetch(spark, sf):
    return docs(spark, sf).filter(F.col("path").isin("src7/d7.md", "src0/g0/index.py", "src2/d2.md")).select("collection", "path", "content")


# --- evaluation


_GOLD = f"""
gold as (select q.qid as query_id, min(d.path) as expected_path from q join (select item_id, text from benchmark) b on b.item_id = q.qid
         join docs d on contains(d.content, b.text) group by q.qid),
merged as (select * from (select qid, path, row_number() over (partition by qid order by 1.0e0 / (60 + rank) desc, list_position(['en', 'fr', 'de', 'es', 'none'], collection), rank) as rank from kw) x where rank <= 10),
res as (
  select query_id, expected_path, min(case when lower(path) = lower(expected_path) then rank end) as r from gold left join merged on qid = query_id group by all),
ev as (select query_id, expected_path, r as path_first_hit_rank, coalesce(1.0e0 / r, 0.0e0) as rr, coalesce(r = 1, false) as h1, coalesce(r <= 5, false) as h5,
         coalesce(r <= 10, false) as hm, cast(query_id % 7 as double) * 1.5e0 as latency_ms, query_id % 3 = 0 as fb, 'c' || query_id % 4 as category,
         regexp_extract(expected_path, '[.][^.]+$') as file_type, case when query_id % 2 = 0 then 'bm25' else 'hybrid' end as mode from res)"""
_EVAL = f"with {S.SCORED}{S.keyword(5)}, {_GOLD}"


def golden(spark, sf) -> DataFrame:
    """Items that some document holds verbatim, with the first such path.

    An item of seven words or more meets documents at its second to fifth word, which stand in the
    document as they are; shorter ones, of which a golden set has few, are looked for in every document."""
    items = table(spark, sf, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), "text", F.split("text", SPACES).alias("w"))
    content = docs(spark, sf).select("path", "content", F.split("content", SPACES).alias("w"))
    gram = lambda w, i: F.xxhash64(*(F.get(w, i + k) for k in range(4)))
    at = F.array_distinct(F.transform(F.slice("w", 1, F.greatest(F.size("w") - 3, F.lit(0))), lambda x, i: gram(F.col("w"), i)))
    keyed = content.withColumn("keys", at).select("path", "content", F.explode_outer("keys").alias("key"))
    long = keyed.join(items.filter(F.size("w") >= 7).select("query_id", "text", gram(F.col("w"), F.lit(1)).alias("key")), "key")
    short = content.join(items.filter(F.size("w") < 7).select("query_id", "text"), F.contains(F.col("content"), F.col("text")))
    both = long.select("query_id", "path", "content", "text").unionByName(short.select("query_id", "path", "content", "text"))
    found = both.filter(F.contains(F.col("content"), F.col("text")))
    return found.groupBy("query_id").agg(F.min("path").alias("expected_path")).withColumn("alternate_paths", F.lit(None).cast("array<string>"))


def results(spark, sf) -> DataFrame:
    hits = fusion.merge_collections(B.keyword_search(index(spark, sf, whole=False), asked(spark, sf), 5), _ORDER, 10)
    hits = hits.select(F.col("qid").alias("query_id"), F.col("merged_rank").alias("rank"), "path")
    rows = evaluate.query_metrics(evaluate.first_hit_rank(golden(spark, sf), hits, 10), 10)
    q = F.col("query_id")
    return rows.withColumns(
        {
            "latency_ms": (q % 7).cast("double") * 1.5, "adaptive_fallback_used": q % 3 == 0, "category": F.concat(F.lit("c"), (q % 4).cast("string")),
            "file_type": F.regexp_extract("expected_path", r"\.[^.]+$", 0), "mode": F.when(q % 2 == 0, "bm25").otherwise("hybrid"),
        }
    )


@register(f"{_EVAL} select query_id, expected_path, path_first_hit_rank from ev")
def first_hit_rank(spark, sf):
    return longs(results(spark, sf).select("query_id", "expected_path", "path_first_hit_rank"))


@register(f"{_EVAL} select query_id, round(rr, 6) as reciprocal_rank from ev")
def reciprocal_rank(spark, sf):
    return results(spark, sf).select("query_id", r6("path_reciprocal_rank").alias("reciprocal_rank"))


@register(f"{_EVAL} select query_id, h1 as hit_at_1, h5 as hit_at_5, hm as within_max_rank from ev")
def hit_at_k(spark, sf):
    return results(spark, sf).select("query_id", F.col("top_1_path_hit").alias("hit_at_1"), F.col("top_5_path_hit").alias("hit_at_5"), F.col("path_hit_within_max_rank").alias("within_max_rank"))


@register(f"with {S.KB} select path, lower(path) in ('src1/d1.md', 'src2/d2.md') as matches from docs")
def path_match(spark, sf):
    alternates = F.array(F.lit("src2/d2.md"))
    return docs(spark, sf).select("path", evaluate.path_matches(F.upper("path"), F.lit("SRC1/d1.md"), alternates).alias("matches"))


@register("select d.doc_id, len(list_filter(['the', 'et', 'und', 'of'], lambda k: contains(lower(d.text), lower(k)))) >= 2 as hit from documents d")
def keyword_hit(spark, sf):
    keywords = F.array(*(F.lit(w) for w in ("the", "et", "und", "of")))
    return table(spark, sf, "documents").select("doc_id", evaluate.keyword_hit(keywords, F.col("text"), F.lit(2)).alias("hit"))


@register("select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 0.99), 6) as p99 from events group by event_type")
def percentile_linear(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(*(r6(F.percentile("value", F.lit(p / 100))).alias(f"p{p}") for p in (50, 95, 99)))


_SUMMARY = """select count(*) as queries, round(avg(h1::int), 6) as top_1, round(avg(h5::int), 6) as top_5, round(avg(rr), 6) as mrr, round(quantile_cont(latency_ms, 0.5), 6) as p50,
  round(quantile_cont(latency_ms, 0.95), 6) as p95, round(quantile_cont(latency_ms, 0.99), 6) as p99, round(avg(latency_ms), 6) as mean_latency_ms, round(avg(fb::int), 6) as fallback_rate from ev"""


@register(f"{_EVAL} {_SUMMARY}")
def metrics_summary(spark, sf):
    rows = evaluate.summary(results(spark, sf))
    return rows.select("queries", *(r6(c).alias(c) for c in rows.columns[1:]))


_BY = "count(*) as queries, cast(sum(h1::int) as bigint) as top_1_hits, cast(sum(h5::int) as bigint) as top_5_hits, round(avg(latency_ms), 6) as mean_latency_ms from ev group by all"


@register(f"{_EVAL} select category, {_BY}")
def by_category(spark, sf):
    return evaluate.by(results(spark, sf), "category").withColumn("mean_latency_ms", r6("mean_latency_ms"))


@register(f"{_EVAL} select file_type, {_BY}")
def by_file_type(spark, sf):
    return evaluate.by(results(spark, sf), "file_type").withColumn("mean_latency_ms", r6("mean_latency_ms"))


@register(f"{_EVAL} select query_id, case when before then 'lost' else 'gained' end as change from (select query_id, h1 and query_id % 5 <> 0 as before, h1 and query_id % 4 <> 0 as after from ev) x where before <> after")
def regression_compare(spark, sf):
    rows = results(spark, sf).select("query_id", "top_1_path_hit")
    before = rows.withColumn("top_1_path_hit", F.col("top_1_path_hit") & (F.col("query_id") % 5 != 0))
    return evaluate.changes(before, rows.withColumn("top_1_path_hit", F.col("top_1_path_hit") & (F.col("query_id") % 4 != 0)))


@register(f"{_EVAL} select 'again' as name, true as consistent, count(*) as categories from (select distinct category from ev) x")
def report_consistency(spark, sf):
    """Aggregates equal those made anew from the rows in another order."""
    # written: both sides are made from one evaluation
    rows = written(results(spark, sf), "results")
    a, b = evaluate.by(rows, "category"), evaluate.by(rows.repartition(3), "category")
    differs = a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count("*").alias("n"))
    return a.agg(F.count("*").alias("categories")).crossJoin(differs).select(F.lit("again").alias("name"), (F.col("n") == 0).alias("consistent"), "categories")


@register(f"{_EVAL} select mode, category, cast(grouping(category) as bigint) as whole_mode, count(*) as queries, cast(sum((not h1)::int) as bigint) as failures, round(avg(rr), 6) as mrr from ev group by grouping sets ((mode), (mode, category))")
def battle_aggregate(spark, sf):
    return evaluate.battle(results(spark, sf)).withColumn("mrr", r6("mrr"))


# --- sources: the documents as files of a folder


def _folder(spark, sf) -> str:
    """A folder that executors share, with a file for each document, some of them hidden, ignored or empty."""
    root = Path(scratch(spark, "kb").removeprefix("file://"))
    for r in kb(spark, sf).select("doc_id", "path", "content").toLocalIterator():
        file = root / r.path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"" if r.doc_id % 19 == 0 else r.content.encode("utf-8"))
    (root / paths.IGNORE_FILE).write_text("src3/\n/src1/d1*\n!src1/d11*\n*.yaml\n!src2/**\n", encoding="utf-8")
    return str(root)


_SEEN = """not starts_with(path, 'src3/') and case when starts_with(path, 'src2/') then true when extension = '.yaml' then false
    when regexp_matches(path, '^src1/d11') then true else not regexp_matches(path, '^src1/d1[^/]*$') end"""
_BYTES = "case when doc_id % 19 = 0 then '' else content end"


@register(f"with {S.KB} select path, extension, cast(strlen({_BYTES}) as bigint) as size, sha256({_BYTES}) as content_sha, case when doc_id % 19 = 0 then 'empty' else 'captured' end as capture from docs where {_SEEN}")
def scan_kb(spark, sf):
    return live.files(spark, _folder(spark, sf)).select("path", "extension", "size", "content_sha", "capture")


@register(f"with {S.KB} select path, {_SEEN} as kept from docs")
def ignore_rules(spark, sf):
    rules = paths.IgnoreRules("src3/\n/src1/d1*\n!src1/d11*\n*.yaml\n!src2/**\n")
    ignored = mapped(rules.ignored, "boolean")
    return docs(spark, sf).select("path", (~ignored("path")).alias("kept"))


@register(f"with {S.KB} select path, replace(replace({_BYTES}, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as content from docs where {_SEEN}")
def read_text(spark, sf):
    return live.files(spark, _folder(spark, sf)).select("path", "content")


@register(f"with {S.KB} select path, title, folder from docs where {_SEEN} and doc_id % 19 <> 0")
def capture_source(spark, sf):
    """Files to documents: empty ones stay out."""
    return live.documents(live.files(spark, _folder(spark, sf)), "all").select("path", "title", "folder")


@register(f"with {S.KB} select path, split_part(path, '/', 1) as folder, list_last(string_split(path, '/')) as name from docs where {_SEEN}")
def rel_path(spark, sf):
    return live.files(spark, _folder(spark, sf)).select("path", D.folder(F.col("path")).alias("folder"), D.basename(F.col("path")).alias("name"))


def _fronted(spark, sf) -> DataFrame:
    lead = F.concat(F.lit("---\ntitle: Doc "), F.col("doc_id"), F.lit("\naliases: [A"), F.col("doc_id"), F.lit(", 'b c']\nstatus: Superseded\n---\n"))
    return table(spark, sf, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 3 == 0, lead).otherwise(F.lit("")), F.coalesce("text", F.lit(""))).alias("content"))


@register("select doc_id, case when doc_id % 3 = 0 then 'Doc ' || doc_id else '' end as title, case when doc_id % 3 = 0 then 'superseded' else '' end as status, coalesce(text, '') as body from documents")
def frontmatter_split(spark, sf):
    rows = _fronted(spark, sf).withColumn("f", D.front_matter(F.col("content")))
    return rows.select("doc_id", "f.title", "f.status", "f.body")


@register("select doc_id, case when doc_id % 3 = 0 then 'A' || doc_id || '; b c' else '' end as aliases from documents")
def frontmatter_alias_keys(spark, sf):
    return _fronted(spark, sf).withColumn("f", D.front_matter(F.col("content"))).select("doc_id", F.array_join("f.aliases", "; ").alias("aliases"))


# --- parts of the chunker


@register(f"with {S.KB} select path, cast(0 as bigint) as chunk_index, regexp_replace('Document: ' || title || chr(10) || 'Folder: ' || folder || chr(10) || chr(10) || case when aliases <> '' then 'Also known as: ' || aliases || chr(10) || chr(10) else '' end, '[\\s\\p{{Z}}]+$', '') as text from docs")
def empty_source(spark, sf):
    """Documents without a body keep one chunk, that of their card."""
    return longs(chunking.build_chunks(docs(spark, sf).withColumn("content", F.lit(" \n"))).select("path", "chunk_index", "text"))


def _chunker(name: str, type_: str):
    """A method of the chunker as a column function."""
    made = chunking.Chunker()
    return mapped(lambda *a: getattr(made, name)(*a), type_)


@register("select doc_id, case when doc_id % 8 between 1 and 6 then cast(doc_id % 8 as bigint) end as level from documents")
def heading_level(spark, sf):
    section = F.concat(F.lit("\n \n"), F.repeat(F.lit("#"), (F.col("doc_id") % 8).cast("int")), F.lit(" "), F.coalesce("text", F.lit("")))
    section = F.when(F.col("doc_id") % 8 == 0, F.lit("plain")).otherwise(section)
    return table(spark, sf, "documents").select("doc_id", _chunker("level", "long")(section).alias("level"))


@register(f"with {S.CHUNKS} select path, cast(chunk_index as bigint) as chunk_index, case when before is not null and length(right(before, 100)) + 2 + length(piece) <= 1500 then right(before, 100) || chr(10) || chr(10) || piece else piece end as joined from (select path, chunk_index, piece, lag(piece) over (partition by collection, path order by chunk_index) as before from ch) x")
def overlap_prefix(spark, sf):
    before = F.coalesce(F.lag("piece").over(Window.partitionBy("collection", "path").orderBy("chunk_index")), F.lit(""))
    return longs(chunks(spark, sf).select("path", "chunk_index", _chunker("_after", "string")(before, F.col("piece")).alias("joined")))


def _paragraphed(spark, sf) -> DataFrame:
    """Texts with blank lines between their lines."""
    return table(spark, sf, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "\n\n").alias("text"))


@register()
def chunk_paragraphs(spark, sf):
    return _paragraphed(spark, sf).select("doc_id", F.posexplode_outer(_chunker("paragraphs", "array<string>")(F.col("text"))).alias("at", "piece"))


@register()
def heading_context(spark, sf):
    section = F.concat(F.lit("## Part\n### Detail\n\n"), F.col("text"))
    return _paragraphed(spark, sf).filter("text <> ''").select("doc_id", F.posexplode_outer(_chunker("_large", "array<string>")(section)).alias("at", "piece"))


@register()
def merge_tiny(spark, sf):
    return _paragraphed(spark, sf).select("doc_id", F.posexplode_outer(_chunker("_merge", "array<string>")(F.split("text", "\n\n"))).alias("at", "piece"))


@register(f"with {S.CHUNKS} select collection, path, cast(chunk_index as bigint) as chunk_index, cast(chunk_count as bigint) as chunk_count, title, folder, extension, aliases, status, piece, text from ch")
def build_chunks(spark, sf):
    return longs(chunks(spark, sf).select("collection", "path", "chunk_index", "chunk_count", "title", "folder", "extension", "aliases", "status", "piece", "text"))


# --- stopwords, ranks and evidence


def _document_words(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.explode_outer(F.regexp_extract_all(F.lower("text"), F.lit(X.TERM), F.lit(0))).alias("word")).filter("word is not null").distinct()


_WORDS_OF = "(select distinct unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_/-]+')) as word from documents) w"


@register(f"select word, word in {S._list(X.STOPWORDS)} as stops from {_WORDS_OF}")
def stopwords_bm25(spark, sf):
    return _document_words(spark, sf).select("word", F.col("word").isin(*X.STOPWORDS).alias("stops"))


@register(f"select word, {S.norm('word')} in {S._list(X.RANK_STOPWORDS)} as stops from {_WORDS_OF}")
def stopwords_rank(spark, sf):
    return _document_words(spark, sf).select("word", X.normal_term(F.col("word")).isin(*X.RANK_STOPWORDS).alias("stops"))


@register(f"with {S.SCORED} select qid, collection, count(*) as chunks, min(score) > 0 as positive from sc where score > 0 group by qid, collection")
def bm25_positive(spark, sf):
    rows = B.pool(B.chunk_scores(index(spark, sf), asked(spark, sf)), 1 << 30)
    return rows.groupBy("qid", "collection").agg(F.count("*").alias("chunks"), (F.min("score") > 0).alias("positive"))


@register(f"with {S.SCORED}{S.keyword(3)} {_KW}")
def bm25_topk(spark, sf):
    return _evidence(B.keyword_search(index(spark, sf), asked(spark, sf), 3))


@register(f"with {S.SCORED}{S.keyword(10)} select {_KEY}, chunk_score as chunk_score, score as file_score, support, round(overlap, 6) as overlap, covers_query, names_query from kw")
def bm25_evidence(spark, sf):
    rows = B.keyword_search(index(spark, sf), asked(spark, sf), 10)
    return longs(rows.select("qid", *I.KEY, "chunk_score", F.col("score").alias("file_score"), "support", r6("overlap").alias("overlap"), "covers_query", "names_query"))


@register(f"{_BASE} select path, cast(chunk_index as bigint) as chunk_index, cast(sum(v) as bigint) as words, cast(count(*) as bigint) as buckets, cast(arg_min(d, (-v, d)) as bigint) as fullest from cv group by collection, path, chunk_index")
def embed(spark, sf):
    rows = semantic.embed(chunks(spark, sf).select(*I.KEY, "text"), "text", semantic.HashedBackend)
    v = F.col("embedding")
    some = F.filter(v, lambda x: x > 0)
    out = rows.select("path", "chunk_index", F.aggregate(v, F.lit(0.0), lambda a, x: a + x).cast("long").alias("words"), F.size(some).alias("buckets"), (F.array_position(v, F.array_max(v)) - 1).cast("long").alias("fullest"))
    return longs(out.filter("words > 0"))


@register(f"with {S.SCORED}{S.keyword(2)} select qid, collection, count(*) as hits, round(max(case when rank = 1 then score end) / max(case when rank = 2 then score end), 6) as margin from kw group by all")
def gate_depth(spark, sf):
    """The lead of the best document is judged on two of them, also where only one is asked for."""
    made, q = index(spark, sf), asked(spark, sf)
    rows = fusion.margins(B.best_documents(made, B.evidence(made, q, 2), max(1, 2)))
    return rows.select("qid", "collection", "hits", r6("margin").alias("margin"))


@register()
def snippet_dedupe(spark, sf):
    made, q = index(spark, sf), asked(spark, sf)
    hits = B.keyword_search(made, q, 10).join(made.chunks, list(I.KEY)).join(q, "qid")
    rows = presentation.snippets(presentation.quotes(hits), 5, 2)
    return longs(rows.select("qid", "collection", "path", "rank", "doc_no", "snippet", "quote"))


@register()
def search_response(spark, sf):
    """Hits with the strategy, reason and fallback that their query was answered by."""
    hits, route = fusion.adaptive_search(*vectored(spark, sf), 5)
    rows = fusion.merge_collections(hits, _ORDER, 5).join(fusion.merge_routes(route), "qid")
    return longs(rows.select("qid", "merged_rank", "collection", "path", "source", "strategy", "reason", "fallback_used"))


# --- published generations


def _published(spark, sf) -> tuple:
    made = index(spark, sf)
    d = docs(spark, sf)
    sources = incremental.inventory(_files(d))
    root = Path(scratch(spark, "index").removeprefix("file://"))
    store.publish(root, "all", made, sources, Settings(stem=False))
    return store.load(spark, root)


@register(f"with {S.CHUNKS} select count(distinct (collection, path)) as documents, count(*) as chunks, cast(0 as bigint) as vectors from ch")
def schema_assertions(spark, sf):
    found = store.assert_sound(index(spark, sf), incremental.inventory(_files(docs(spark, sf))))
    return spark.createDataFrame([found], "documents long, chunks long, vectors long")


@register(f"with {S.POSTINGS} select collection, term, df from tdf")
def load_generation(spark, sf):
    return _published(spark, sf)[1].term_df
