"""Evaluation of ranked results against golden queries, as aggregates over all of them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the regression gate.
TOP1_DROP, TOP5_DROP, LATENCY_RISE, MOST_REGRESSED = 0.05, 0.03, 0.5, 2


def path_matches(path: Column, expected: Column, alternates: Column) -> Column:
    """Whether a path is an expected one, in any case."""
    names = F.transform(F.concat(F.array(expected), F.coalesce(alternates, F.array().cast("array<string>"))), F.lower)
    return F.array_contains(names, F.lower(path))


def first_hit_rank(golden: DataFrame, hits: DataFrame, top_k: int) -> DataFrame:
    """golden(query_id, expected_path, alternate_paths) and hits(query_id, rank, path): path_first_hit_rank."""
    found = golden.join(hits.filter(F.col("rank") <= top_k), "query_id", "left")
    match = path_matches(F.col("path"), F.col("expected_path"), F.col("alternate_paths"))
    return found.groupBy(*golden.columns).agg(F.min(F.when(match, F.col("rank"))).alias("path_first_hit_rank"))


def query_metrics(rows: DataFrame, top_k: int) -> DataFrame:
    r = F.col("path_first_hit_rank")
    most = F.coalesce(F.col("max_rank"), F.lit(top_k)) if "max_rank" in rows.columns else F.lit(top_k)
    return rows.withColumns(
        {
            "path_reciprocal_rank": F.coalesce(1.0 / r, F.lit(0.0)),
            "top_1_path_hit": F.coalesce(r == 1, F.lit(False)),
            "top_5_path_hit": F.coalesce(r <= 5, F.lit(False)),
            "path_hit_within_max_rank": F.coalesce(r <= most, F.lit(False)),
        }
    )


def keyword_hit(keywords: Column, body: Column, need: Column) -> Column:
    """At least `need` of the expected keywords are in body, in any case."""
    low = F.lower(body)
    return F.size(F.filter(keywords, lambda k: F.contains(low, F.lower(k)))) >= need


def _mean(flag: str) -> Column:
    return F.avg(F.col(flag).cast("double"))


def summary(results: DataFrame, adaptive: bool = True) -> DataFrame:
    """One row: accuracies, MRR, latency percentiles (linear, inclusive), share of fallbacks."""
    fallback = _mean("adaptive_fallback_used") if adaptive else F.lit(None).cast("double")
    return results.agg(
        F.count("*").alias("queries"), _mean("top_1_path_hit").alias("top_1"), _mean("top_5_path_hit").alias("top_5"),
        F.avg("path_reciprocal_rank").alias("mrr"), *(F.percentile("latency_ms", F.lit(p / 100)).alias(f"p{p}") for p in (50, 95, 99)),
        F.avg("latency_ms").alias("mean_latency_ms"), fallback.alias("fallback_rate"),
    )


def by(results: DataFrame, key: str) -> DataFrame:
    return results.groupBy(key).agg(
        F.count("*").alias("queries"), F.sum(F.col("top_1_path_hit").cast("long")).alias("top_1_hits"),
        F.sum(F.col("top_5_path_hit").cast("long")).alias("top_5_hits"), F.avg("latency_ms").alias("mean_latency_ms"),
    )


def battle(results: DataFrame) -> DataFrame:
    """Per mode over all knowledge bases, and per mode and category the failures, in one pass."""
    failed = F.sum((~F.col("top_1_path_hit")).cast("long"))
    return results.groupingSets([["mode"], ["mode", "category"]], "mode", "category").agg(
        F.grouping("category").cast("long").alias("whole_mode"), F.count("*").alias("queries"), failed.alias("failures"),
        F.avg("path_reciprocal_rank").alias("mrr"),
    )


@dataclass(frozen=True)
class Regression:
    failed: bool
    reasons: list[str] = field(default_factory=list)
    lost: list[str] = field(default_factory=list)
    gained: list[str] = field(default_factory=list)


def changes(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(query_id, change) of queries whose first place was lost or gained."""
    a = baseline.select("query_id", F.col("top_1_path_hit").alias("before"))
    b = current.select("query_id", F.col("top_1_path_hit").alias("after"))
    change = F.when(F.col("before") & ~F.col("after"), "lost").when(~F.col("before") & F.col("after"), "gained")
    return a.join(b, "query_id").withColumn("change", change).filter(F.col("change").isNotNull()).select("query_id", "change")


def compare(baseline: DataFrame, current: DataFrame, check_latency: bool = False) -> Regression:
    """The regression gate. Both sides must have the same queries."""
    if baseline.select("query_id").exceptAll(current.select("query_id")).limit(1).count() or current.select("query_id").exceptAll(baseline.select("query_id")).limit(1).count():
        raise ValueError("baseline and current have different queries")
    a, b = summary(baseline, False).first(), summary(current, False).first()
    moved = changes(baseline, current).orderBy("query_id").collect()  # bounded by the golden set
    lost, gained = ([r["query_id"] for r in moved if r["change"] == k] for k in ("lost", "gained"))
    reasons = []
    if a["top_1"] - b["top_1"] > TOP1_DROP:
        reasons.append(f"top-1 fell from {a['top_1']:.3f} to {b['top_1']:.3f}")
    if a["top_5"] - b["top_5"] > TOP5_DROP:
        reasons.append(f"top-5 fell from {a['top_5']:.3f} to {b['top_5']:.3f}")
    if check_latency and a["p95"] and b["p95"] > a["p95"] * (1 + LATENCY_RISE):
        reasons.append(f"p95 rose from {a['p95']:.2f} to {b['p95']:.2f} ms")
    if len(lost) >= MOST_REGRESSED:
        reasons.append(f"{len(lost)} queries lost the first place")
    return Regression(bool(reasons), reasons, lost, gained)


def consistent(report: DataFrame, recomputed: DataFrame) -> bool:
    """Whether stored aggregates equal those made anew from the rows."""
    return not report.exceptAll(recomputed).limit(1).count() and not recomputed.exceptAll(report).limit(1).count()
