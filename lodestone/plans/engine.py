"""The public facade: collections, searches as text or frames, listing, statistics, reindexing, diagnosis."""

from __future__ import annotations

import time
from collections import OrderedDict
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import lexical as X
from lodestone.operators import bm25, chunking, fusion, incremental, presentation, semantic
from lodestone.operators import index as I
from lodestone.operators.filters import Filters, checked_limit, parse
from lodestone.runtime import ship, written
from lodestone.settings import CorruptIndexError, NotFoundError, OperationError, ReindexError, Settings, distinct_targets
from lodestone.sources import kb, store
from lodestone.sources.paths import IgnoreRules, excluded

CACHED_QUERIES = 1000
MODES = ("adaptive", "keyword", "semantic", "hybrid")
BACKENDS = {"hashed-64": semantic.HashedBackend}


@dataclass
class Collection:
    name: str
    root: Path
    location: Path
    generation: str | None = None
    opened: tuple | None = field(default=None, repr=False)


@dataclass(frozen=True)
class Diagnosis:
    """What doctor() finds of one collection."""

    collection: str
    state: str  # missing, unknown, corrupt, incompatible, stale or healthy
    detail: str
    files: dict
    probe_ms: float | None = None
    probe_error: str | None = None

    @property
    def ok(self) -> bool:
        return bool(self.files["visible"]) and self.state == "healthy" and self.probe_error is None


class Engine:
    def __init__(self, spark: SparkSession, settings: Settings | None = None, collections: dict[str, str | Path] | None = None, backend: type | None = None):
        ship(spark)
        self.spark, self.settings = spark, settings or Settings.from_env()
        roots = {k: Path(v) for k, v in collections.items()} if collections else self.settings.resolved_collections()
        one = len(roots) == 1
        targets = {k: self.settings.index_location(r, None if one else k) for k, r in roots.items()}
        distinct_targets(targets)
        self.collections = {k: Collection(k, r, targets[k]) for k, r in roots.items()}
        self.backend = backend or BACKENDS.get(self.settings.model)
        self._made = None
        self._vectors: OrderedDict[str, list[float]] = OrderedDict()
        self.cache_hits = self.cache_misses = 0

    # --- collections and their indexes

    def resolve(self, name: str | None = None) -> list[Collection]:
        if name is None or name.lower() == "all":
            return list(self.collections.values())
        if name not in self.collections:
            raise OperationError(f"unknown collection {name!r}; known: {', '.join(self.collections)}")
        return [self.collections[name]]

    def _documents(self, c: Collection) -> tuple[DataFrame, DataFrame]:
        # read once: inventory and documents must be of one state
        captured = written(kb.files(self.spark, c.root, self.settings.exclude), f"files-{c.name}")
        return captured.select("path", "extension", "mtime", "size", "content_sha"), kb.documents(captured, c.name)

    def _embed(self, rows: DataFrame) -> DataFrame:
        return semantic.embed(rows, "text", self.backend).select(*I.KEY, "embedding")

    def _build(self, c: Collection, force: bool = False) -> store.Manifest:
        s = self.settings
        with store.writer_lock(c.location):
            sources, docs = self._documents(c)
            prior = None
            if not force:
                try:
                    prior = store.load(self.spark, c.location)
                except CorruptIndexError:
                    prior = None
            if prior and prior[0].recipe_sha == store.fingerprint(s.recipe()):
                changed = written(incremental.change_detect(prior[2], sources), "changes")
                same = prior[2].select(*sources.columns).exceptAll(sources).limit(1).count() == 0
                if same and changed.filter("change <> 'unchanged'").limit(1).count() == 0:
                    return prior[0]
                made = incremental.incremental_build(prior[1], docs, changed, s.chunk_size, s.overlap, "headings", self._embed)
            else:
                cut = written(chunking.build_chunks(docs, s.chunk_size, s.overlap), "chunks")
                made = I.build(cut, s.stem, s.k1, s.b)
                if self.backend:
                    made = made.with_vectors(self._embed(cut.select(*I.KEY, "text")))
            return store.publish(c.location, c.name, made, sources, s)

    def index(self, c: Collection, build: bool = True) -> I.Index | None:
        """The published index, opened again when another was published, built when there is none."""
        name = store.read_pointer(c.location)
        if name is None:
            if not build:
                return None
            self._build(c)
            name = store.read_pointer(c.location)
        if c.generation != name:
            c.opened = store.load(self.spark, c.location)
            c.generation = c.opened[0].generation
        return c.opened[1]

    def reindex(self, collection: str | None = None, force: bool = False) -> dict[str, store.Manifest]:
        done, failed = {}, {}
        for c in self.resolve(collection):
            try:
                done[c.name] = self._build(c, force)
            except Exception as x:  # the others are still rebuilt; all failures are told together
                failed[c.name] = f"{type(x).__name__}: {x}"
        if failed:
            raise ReindexError(sorted(done), failed)
        return done

    # --- searching

    def _queries(self, queries: DataFrame | str) -> DataFrame:
        if isinstance(queries, str):
            queries = self.spark.createDataFrame([(0, queries)], "qid long, query string")
        return queries.select(F.col("qid").cast("long").alias("qid"), "query")

    def _with_vectors(self, c: Collection, index: I.Index, queries: DataFrame, query: str | None) -> DataFrame:
        if self.backend is None:
            raise OperationError(f"no backend for model {self.settings.model!r}")
        recipe, mine = c.opened[0].recipe, self.settings.recipe()
        if index.vectors is None or any(recipe[k] != mine[k] for k in ("model", "dims", "runtime")):
            raise OperationError("the index has other vectors than this backend's; reindex")
        if query is None:
            return semantic.embed(queries, "query", self.backend)
        return self.spark.createDataFrame([(0, query, self._vector(query))], "qid long, query string, embedding array<float>")

    def _vector(self, query: str) -> list[float]:
        """A single query's vector, kept for the next time it is asked."""
        if query in self._vectors:
            self.cache_hits += 1
            self._vectors.move_to_end(query)
            return self._vectors[query]
        self.cache_misses += 1
        self._made = self._made or self.backend()
        found = [float(x) for x in self._made.encode([query])[0]]
        self._vectors[query] = found
        if len(self._vectors) > CACHED_QUERIES:
            self._vectors.popitem(last=False)
        return found

    def warm_up(self) -> None:
        """Load the backend and open the indexes before the first request."""
        self._vector("warm up")
        for c in self.resolve():
            self.index(c, build=False)

    def search(self, queries: DataFrame | str, mode: str = "adaptive", top_k: int = 10, filters: Filters = Filters(), collection: str | None = None, build: bool = True) -> tuple[DataFrame, DataFrame | None]:
        """(hits, routes) for one query or a frame (qid, query), merged over collections by rank.

        hits: qid, merged_rank, rank, collection, path, chunk_index, score, rrf, source and chunk columns."""
        if mode not in MODES:
            raise OperationError(f"unknown mode {mode!r}")
        asked, single = self._queries(queries), queries if isinstance(queries, str) else None
        found, ways, chosen = [], [], self.resolve(collection)
        for c in chosen:
            index = self.index(c, build)
            if index is None:
                continue
            none = F.lit(None).cast("double")
            columns = ("qid", *I.KEY, "rank", "score", "rrf", "source")
            if mode == "keyword":
                hits = bm25.keyword_search(index, asked, top_k, filters).withColumns({"rrf": none, "source": F.lit("keyword")})
            elif mode == "semantic":
                hits = semantic.semantic_search(index, self._with_vectors(c, index, asked, single), top_k, filters).withColumns({"rrf": none, "source": F.lit("semantic")})
            elif mode == "hybrid":
                hits = fusion.hybrid_search(index, self._with_vectors(c, index, asked, single), top_k, filters).withColumn("source", F.lit("hybrid"))
            else:
                hits, route = fusion.adaptive_search(index, self._with_vectors(c, index, asked, single), top_k, filters)
                ways.append(route)
            hits = fusion.with_hints(index, hits.select(*columns), asked)
            if mode == "adaptive":
                hits = hits.join(I.neighbors(index.chunks, hits), list(I.KEY), "left")
            found.append(hits)
        if not found:
            raise OperationError("there is no index yet")
        hits, route = found[0], ways[0] if ways else None
        for h in found[1:]:
            hits = hits.unionByName(h)
        for r in ways[1:]:
            route = route.unionByName(r)
        return fusion.merge_collections(hits, [c.name for c in chosen], top_k), fusion.merge_routes(route) if route is not None else None

    def _rows(self, hits: DataFrame, shown: int = 0) -> list[dict]:
        """Hits as dicts; with shown, those of the first documents carry their place and their snippet's."""
        quoted = presentation.quotes(hits).withColumn("matched", X.matched_terms(F.col("query"), F.col("quote")))
        if shown:
            places = presentation.snippets(quoted, shown, order="merged_rank").select("qid", "merged_rank", "doc_no", "snippet")
            quoted = quoted.join(places, ["qid", "merged_rank"], "left")
        rows = [r.asDict() for r in quoted.orderBy("merged_rank").collect()]  # at most 100
        if len(self.collections) == 1:
            for r in rows:
                r["collection"] = ""
        return rows

    def search_text(self, query: str, top_k: int = 10, collection: str | None = None, **filters) -> str:
        """Adaptive search, as text."""
        f = parse(**filters)
        checked_limit(top_k)
        if not query.strip():
            return presentation.render_context([], {"strategy": "keyword", "reason": "empty query", "fallback_used": False}, f)
        hits, route = self.search(query, "adaptive", top_k, f, collection)
        return presentation.render_context(self._rows(hits, top_k), route.first().asDict(), f)

    def results_text(self, query: str, mode: str, top_k: int | None = None, collection: str | None = None, **filters) -> str:
        """Keyword, semantic or hybrid search, as a flat list."""
        top_k = checked_limit(top_k if top_k is not None else 20 if mode == "keyword" else 10)
        f = parse(**filters)
        if not query.strip():
            return presentation.render_results([])
        return presentation.render_results(self._rows(self.search(query, mode, top_k, f, collection)[0]))

    # --- documents, statistics, diagnosis

    def get_document(self, path: str, collection: str | None = None) -> str:
        """The live file, from the first collection that has it."""
        for c in self.resolve(collection):
            file = c.root / path
            if path and not Path(path).is_absolute() and file.is_file() and file.suffix.lower() in kb.D.EXTENSIONS:
                if not excluded(file, c.root, self.settings.exclude) and not IgnoreRules.load(c.root).ignored(path):
                    return f"# {path}\n\n{kb.read_file(c.root, path)[-1]}"
        raise NotFoundError(f"no visible document {path!r}")

    def list_documents(self, collection: str | None = None, folder: str | None = None, limit: int = 100, **filters) -> DataFrame:
        checked_limit(limit, 500)
        rows = None
        for c in self.resolve(collection):
            captured = kb.files(self.spark, c.root, self.settings.exclude).withColumn("collection", F.lit(c.name))
            rows = captured if rows is None else rows.unionByName(captured)
        return presentation.listing(rows, parse(**filters), folder, limit)

    def stats(self, collection: str | None = None) -> list[dict]:
        out = []
        for c in self.resolve(collection):
            m = store.read_manifest(c.location)
            out.append({"collection": c.name, "generation": m and m.generation, "documents": m.documents if m else 0, "chunks": m.chunks if m else 0,
                        "model": self.settings.model, "cached_queries": len(self._vectors), "cache_hits": self.cache_hits, "cache_misses": self.cache_misses, "chunking": f"{self.settings.chunk_size} characters, overlap {self.settings.overlap or 'off'}"})
        return out

    def diagnose(self, c: Collection, probe: str | None = "overview") -> Diagnosis:
        scan = kb.survey(c.root, self.settings.exclude)
        try:
            manifest = store.read_manifest(c.location)
            if manifest is None:
                return Diagnosis(c.name, "missing", "no index has been published", scan)
            if manifest.recipe_sha != store.fingerprint(self.settings.recipe()):
                return Diagnosis(c.name, "incompatible", "the index was built by another recipe", scan)
            _, _, prior = store.load(self.spark, c.location)
        except CorruptIndexError as x:
            return Diagnosis(c.name, "corrupt", str(x), scan)
        except OSError as x:
            return Diagnosis(c.name, "unknown", str(x), scan)
        now = kb.files(self.spark, c.root, self.settings.exclude)
        counts = {r["change"]: r["count"] for r in incremental.change_detect(prior, now).groupBy("change").count().collect()}
        stale = {k: v for k, v in counts.items() if k != "unchanged"}
        state, detail = ("stale", ", ".join(f"{v} {k}" for k, v in sorted(stale.items()))) if stale else ("healthy", f"{counts.get('unchanged', 0)} files")
        took = error = None
        if probe:
            began = time.perf_counter()
            try:
                self.search(probe, "adaptive", 5, collection=c.name, build=False)[0].collect()
                took = 1000 * (time.perf_counter() - began)
            except Exception as x:  # the probe's failure is part of the report
                error = f"{type(x).__name__}: {x}"[:300]
        return Diagnosis(c.name, state, detail, scan, took, error)

    def doctor(self, probe: str | None = "overview") -> tuple[bool, list[Diagnosis]]:
        found = [self.diagnose(c, probe) for c in self.resolve()]
        return all(d.ok for d in found), found
