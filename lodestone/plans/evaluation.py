"""Evaluation runs: golden queries from YAML, one batched search for all of them, reports, gates, suites.

python -m lodestone.plans.evaluation --kb FOLDER --golden FILE [--mode adaptive] [--baseline FILE] [--promote FILE]
"""

from __future__ import annotations

import argparse
import json
import math
import platform
import subprocess
import sys
import time
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, fields
from datetime import datetime, timezone
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import evaluate
from lodestone.plans.engine import Engine
from lodestone.runtime import session, written
from lodestone.settings import Settings
from lodestone.sources import store

METRICS = "path-and-keyword-1"
LATENCY = "one batch of all queries, shared out evenly"
MODES = ("keyword", "semantic", "hybrid", "adaptive")
# Inputs that must be equal for two runs to be compared.
INPUTS = ("corpus", "queries", "query_ids", "scope", "metrics", "top_k", "min_keywords", "strict_keywords", "strict_top_1", "latency")


@dataclass(frozen=True)
class Golden:
    id: str
    query: str
    category: str
    expected_path: str
    expected_keywords: tuple[str, ...] = ()
    alternate_paths: tuple[str, ...] = ()
    file_type: str = ".md"
    description: str = ""
    difficulty: str = "easy"
    quick_set: bool = False
    stress_set: bool = False
    min_keywords: int | None = None
    max_rank: int | None = None

    @classmethod
    def read(cls, raw: object) -> "Golden":
        if not isinstance(raw, dict):
            raise ValueError(f"a golden query must be a mapping, not {raw!r}")
        unknown = set(raw) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown fields {sorted(unknown)}")
        made = dict(raw)
        for name in ("id", "query", "category", "expected_path"):
            if not isinstance(made.get(name), str) or not made[name].strip():
                raise ValueError(f"{name} must be text: {raw!r}")
        for name in ("expected_keywords", "alternate_paths"):
            items = made.get(name, [])
            # numbers are allowed as keywords, such as status codes
            items = [str(x) if type(x) in (int, float) and name == "expected_keywords" else x for x in items] if isinstance(items, list) else None
            if items is None or any(not isinstance(x, str) or not x for x in items):
                raise ValueError(f"{name} must be a list of texts: {raw!r}")
            made[name] = tuple(items)
        for name in ("quick_set", "stress_set"):
            if not isinstance(made.get(name, False), bool):
                raise ValueError(f"{name} must be true or false")
        for name, least in (("min_keywords", 0), ("max_rank", 1)):
            v = made.get(name)
            if v is not None and (type(v) is not int or v < least):
                raise ValueError(f"{name} must be a whole number from {least}")
        for p in (made["expected_path"], *made["alternate_paths"]):
            if PurePosixPath(p).is_absolute() or ".." in PurePosixPath(p).parts:
                raise ValueError(f"{p!r} is not a path within the knowledge base")
        if (made.get("min_keywords") or 0) > len(made["expected_keywords"]):
            raise ValueError("min_keywords exceeds the number of expected keywords")
        return cls(**made)


@dataclass(frozen=True)
class Scope:
    """Which golden queries run; stress queries only when asked for."""

    quick: bool = False
    stress_only: bool = False
    include_stress: bool = False
    categories: tuple[str, ...] = ()
    file_types: tuple[str, ...] = ()

    def takes(self, g: Golden) -> bool:
        if g.stress_set != self.stress_only and not (self.include_stress and not self.stress_only):
            return False
        return (
            (g.quick_set or not self.quick) and (not self.categories or g.category in self.categories)
            and (not self.file_types or g.file_type in self.file_types)
        )


def _yaml(path: Path) -> dict:
    import yaml

    try:
        raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError:
        raise ValueError(f"no such file: {path}") from None
    except yaml.YAMLError as x:
        raise ValueError(f"{path}: {x}") from None
    if not isinstance(raw, dict) or str(raw.get("version", "1.0")) != "1.0":
        raise ValueError(f"{path}: expected a mapping of version 1.0")
    return raw


def load_golden(path: Path, scope: Scope = Scope()) -> list[Golden]:
    raw = _yaml(path)
    unknown = set(raw) - {"version", "description", "queries"}
    if unknown or not isinstance(raw.get("queries"), list):
        raise ValueError(f"{path}: unknown fields {sorted(unknown)}" if unknown else f"{path}: no queries")
    found = [Golden.read(q) for q in raw["queries"]]
    if len({g.id for g in found}) != len(found):
        raise ValueError(f"{path}: an id stands twice")
    kept = [g for g in found if scope.takes(g)]
    if not kept:
        raise ValueError("no golden query is in scope")
    return kept


def run(engine: Engine, golden: Sequence[Golden], mode: str = "adaptive", top_k: int = 5, min_keywords: int = 2, strict: bool = False, strict_top_1: bool = False) -> DataFrame:
    """One row per golden query, from one batched search."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    kind = "query_id string, query string, category string, expected_path string, expected_keywords array<string>, alternate_paths array<string>, file_type string, need int, max_rank int, qid long"

    def need(g: Golden) -> int:
        return g.min_keywords if g.min_keywords is not None else len(g.expected_keywords) if strict else min_keywords

    rows = [(g.id, g.query, g.category, g.expected_path, list(g.expected_keywords), list(g.alternate_paths), g.file_type, need(g), g.max_rank, i) for i, g in enumerate(golden)]
    asked = engine.spark.createDataFrame(rows, kind)
    began = time.perf_counter()
    hits, routes = engine.search(asked.select("qid", "query"), mode, top_k)
    hits = written(hits.select("qid", F.col("merged_rank").alias("rank"), "path", "score", "text"), "eval-hits")
    latency = 1000 * (time.perf_counter() - began) / len(rows)
    top = hits.groupBy("qid").agg(
        F.max(F.when(F.col("rank") == 1, F.col("path"))).alias("retrieved_path"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("retrieved_score"),
        F.max(F.when(F.col("rank") == 1, F.col("text"))).alias("_first"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]), "\n").alias("_all"),
    )
    ranks = evaluate.first_hit_rank(asked.select(F.col("qid").alias("query_id"), "expected_path", "alternate_paths"), hits.withColumnRenamed("qid", "query_id"), top_k)
    ranks = ranks.select(F.col("query_id").alias("qid"), "path_first_hit_rank")
    out = evaluate.query_metrics(asked.join(ranks, "qid").join(top, "qid", "left"), top_k)
    body = F.coalesce("_first" if strict_top_1 else "_all", F.lit(""))
    found = lambda text: F.filter("expected_keywords", lambda k: F.contains(F.lower(text), F.lower(k)))
    hit = F.col("retrieved_path").isNotNull()
    out = out.withColumns(
        {
            "top_1_keyword_hit": hit & evaluate.keyword_hit(F.col("expected_keywords"), F.coalesce("_first", F.lit("")), F.col("need")),
            "top_5_keyword_hit": hit & evaluate.keyword_hit(F.col("expected_keywords"), body, F.col("need")),
            "keywords_found": found(body), "keywords_missing": F.array_except("expected_keywords", found(body)),
            "retrieved_path": F.coalesce("retrieved_path", F.lit("(no results)")), "retrieved_score": F.coalesce("retrieved_score", F.lit(0.0)),
            "latency_ms": F.lit(latency),
        }
    )
    way = routes.select("qid", F.col("strategy").alias("adaptive_strategy"), F.col("fallback_used").alias("adaptive_fallback_used")) if routes is not None else None
    if way is not None:
        out = out.join(way, "qid", "left")
    else:
        out = out.withColumns({"adaptive_strategy": F.lit(None).cast("string"), "adaptive_fallback_used": F.lit(None).cast("boolean")})
    return written(out.drop("_first", "_all", "need", "qid", "expected_keywords", "alternate_paths", "max_rank"), "eval-results")


def _revision() -> str:
    here = Path(__file__).parent
    try:
        return subprocess.run(["git", "-C", str(here), "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def contents(sources: DataFrame) -> list[int]:
    """A digest of (path, content_sha) of all sources, in any order: their number, and sums of eight parts of a hash."""
    h = F.sha2(F.concat_ws("\n", "path", "content_sha"), 256)
    parts = [F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long") for k in range(8)]
    row = sources.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(p), F.lit(0)).alias(f"s{k}") for k, p in enumerate(parts))).first()
    return list(row)


def manifest(engine: Engine, golden: Sequence[Golden], scope: Scope, mode: str, top_k: int = 5, min_keywords: int = 2, strict: bool = False, strict_top_1: bool = False) -> dict:
    corpus = []
    for c in engine.resolve():
        engine.index(c)
        corpus.append((c.name, *contents(c.opened[2])))
    return {
        "corpus": store.fingerprint(corpus), "queries": store.fingerprint([asdict(g) for g in golden]), "query_ids": [g.id for g in golden],
        "scope": json.loads(json.dumps(asdict(scope))), "metrics": METRICS, "top_k": top_k, "min_keywords": min_keywords, "strict_keywords": strict, "strict_top_1": strict_top_1,
        "latency": LATENCY, "mode": mode, "recipe": engine.settings.recipe(), "revision": _revision(), "host": f"{platform.system()}-{platform.machine()}-python{platform.python_version()}",
    }


def differences(current: dict | None, baseline: dict | None, compare_latency: bool = True) -> list[str]:
    """What differs without harm; inputs that differ are an error."""
    if not current or not baseline:
        raise ValueError("a report without a manifest cannot be compared")
    names = (*INPUTS, *(["host"] if compare_latency else []))
    if changed := [n for n in names if current.get(n) != baseline.get(n)]:
        raise ValueError("the runs differ in " + ", ".join(changed))
    return [n for n in ("mode", "recipe", "revision") if current.get(n) != baseline.get(n)]


def _plain(v):
    return None if isinstance(v, float) and not math.isfinite(v) else v


def report(results: DataFrame, made: dict) -> dict:
    adaptive = made["mode"] == "adaptive"
    one = evaluate.summary(results, adaptive).first().asDict()
    tables = {k: [r.asDict() for r in evaluate.by(results, c).orderBy(c).collect()] for k, c in (("by_category", "category"), ("by_file_type", "file_type"))}
    return {
        "timestamp": datetime.now(timezone.utc).isoformat(), "mode": made["mode"], "manifest": made, "summary": {k: _plain(v) for k, v in one.items()},
        **tables, "results": [r.asDict() for r in results.orderBy("query_id").collect()],  # bounded by the golden set
    }


def frame(engine_or_spark, rep: dict) -> DataFrame:
    spark = getattr(engine_or_spark, "spark", engine_or_spark)
    kind = "query_id string, category string, file_type string, top_1_path_hit boolean, top_5_path_hit boolean, path_reciprocal_rank double, latency_ms double, adaptive_fallback_used boolean"
    names = [x.split()[0] for x in kind.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rep["results"]], kind)


def load_report(spark, path: Path) -> dict:
    """A stored report, refused if its aggregates are not those of its rows."""
    rep = json.loads(Path(path).read_text(encoding="utf-8"))
    again = evaluate.summary(frame(spark, rep), rep["mode"] == "adaptive").first().asDict()
    for k, v in again.items():
        stored = rep["summary"].get(k)
        if (stored is None) != (v is None) or (v is not None and abs(stored - v) > 1e-9):
            raise ValueError(f"{path}: {k} is {stored}, its rows give {v}")
    return rep


def gate(spark, current: dict, baseline: dict, compare_latency: bool = False) -> evaluate.Regression:
    differences(current.get("manifest"), baseline.get("manifest"), compare_latency)
    return evaluate.compare(frame(spark, baseline), frame(spark, current), compare_latency)


def promote(spark, current: dict, path: Path, baseline: dict | None = None) -> Path:
    """Store a report as the new baseline; refused without a manifest or with a regression."""
    if not current.get("manifest"):
        raise ValueError("a report without a manifest cannot be promoted")
    if baseline is not None and (r := gate(spark, current, baseline)).failed:
        raise ValueError("not promoted: " + "; ".join(r.reasons))
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(current, indent=1, sort_keys=True), encoding="utf-8")
    return Path(path)


def latest_baseline(folder: Path, mode: str) -> Path | None:
    found = sorted(Path(folder).glob("*.json"), key=lambda p: p.stat().st_mtime, reverse=True)
    return next((p for p in found if json.loads(p.read_text(encoding="utf-8")).get("mode") == mode), None)


def markdown(rep: dict) -> str:
    s = rep["summary"]
    out = [f"# Evaluation: {rep['mode']}", "", f"{s['queries']} queries, top-1 {s['top_1']:.1%}, top-5 {s['top_5']:.1%}, MRR {s['mrr']:.3f}", ""]
    if s.get("fallback_rate") is not None:
        out += [f"Fallback rate {s['fallback_rate']:.1%}", ""]
    out += ["| Category | Queries | Top-1 | Top-5 |", "| --- | --- | --- | --- |"]
    out += [f"| {r['category']} | {r['queries']} | {r['top_1_hits']} | {r['top_5_hits']} |" for r in rep["by_category"]]
    missed = [r for r in rep["results"] if not r["top_1_path_hit"]]
    out += ["", "## Not first", *(f"- {r['query_id']}: {r['query']} -> {r['retrieved_path']} (rank {r['path_first_hit_rank'] or '-'})" for r in missed)]
    return "\n".join(out)


@dataclass(frozen=True)
class SuiteItem:
    id: str
    kb_path: Path
    golden: list[Golden] = field(repr=False)
    scope: Scope = Scope()


def load_suite(path: Path) -> tuple[list[str], list[SuiteItem]]:
    """Modes and knowledge bases; every golden file is read before anything runs."""
    raw, here = _yaml(path), Path(path).parent
    modes = ["keyword" if m == "bm25" else m for m in raw.get("modes", [])]
    if not modes or len(set(modes)) != len(modes) or set(modes) - set(MODES):
        raise ValueError(f"{path}: modes must be some of {', '.join(MODES)}, each once")
    items = []
    for k in raw.get("knowledge_bases", []):
        scope = Scope(include_stress=bool(k.get("include_stress", False)))
        if not (here / k["kb_path"]).is_dir():
            raise ValueError(f"{path}: not a folder: {k['kb_path']}")
        items.append(SuiteItem(k["id"], here / k["kb_path"], load_golden(here / k["golden_queries"], scope), scope))
    if not items or len({i.id for i in items}) != len(items):
        raise ValueError(f"{path}: knowledge bases must have ids of their own")
    return modes, items


def battle(spark, path: Path, settings: Settings, out: Path, baselines: Path | None = None) -> tuple[DataFrame, list[str]]:
    """Run a suite: reports in out, the pooled aggregate, and what fails against the baselines."""
    modes, items = load_suite(path)
    stored = {(i.id, m): load_report(spark, baselines / f"{i.id}_{m}.json") for i in items for m in modes} if baselines else {}
    Path(out).mkdir(parents=True, exist_ok=True)
    pooled, failures = None, []
    for item in items:
        engine = Engine(spark, settings.but(index_root=str(Path(out) / "index" / item.id)), {item.id: item.kb_path})
        for mode in modes:
            rows = run(engine, item.golden, mode)
            rep = report(rows, manifest(engine, item.golden, item.scope, mode))
            (Path(out) / f"{item.id}_{mode}.json").write_text(json.dumps(rep, indent=1, sort_keys=True), encoding="utf-8")
            if stored and (r := gate(spark, rep, stored[(item.id, mode)])).failed:
                failures.append(f"{item.id}/{mode}: {'; '.join(r.reasons)}; lost {', '.join(r.lost)}")
            rows = rows.withColumns({"mode": F.lit(mode), "kb": F.lit(item.id)})
            pooled = rows if pooled is None else pooled.unionByName(rows)
    return evaluate.battle(pooled), failures


def main(argv: Sequence[str]) -> int:
    p = argparse.ArgumentParser(prog="lodestone-evaluate")
    p.add_argument("--kb", required=True)
    p.add_argument("--golden", required=True, type=Path)
    p.add_argument("--mode", choices=MODES, default="adaptive")
    p.add_argument("--full", action="store_true", help="all but stress queries instead of the quick set")
    p.add_argument("--stress", action="store_true")
    p.add_argument("--include-stress", action="store_true")
    p.add_argument("--category", action="append", default=[])
    p.add_argument("--index-root")
    p.add_argument("--baseline", type=Path)
    p.add_argument("--promote", type=Path)
    a = p.parse_args(argv)
    scope = Scope(not (a.full or a.stress or a.include_stress), a.stress, a.include_stress, tuple(a.category))
    try:
        golden = load_golden(a.golden, scope)
        spark = session("lodestone-evaluate")
        engine = Engine(spark, Settings(index_root=a.index_root), {"kb": a.kb})
        rep = report(run(engine, golden, a.mode), manifest(engine, golden, scope, a.mode))
        print(markdown(rep))
        baseline = load_report(spark, a.baseline) if a.baseline else None
        if baseline is not None and (r := gate(spark, rep, baseline)).failed:
            print("Regression: " + "; ".join(r.reasons))
            return 1
        if a.promote:
            promote(spark, rep, a.promote, baseline)
    except ValueError as x:
        print(f"error: {x}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
