"""Quality classifier with hierarchical empirical Bayes over sites and their sections.

Evidence of a document: the mean log-likelihood ratio of its hashed byte 4-grams (naive Bayes),
calibrated to a probability by logistic regression on rows that the grams were not learned from.
Both are fitted on a bounded sample: at most about SAMPLE labelled rows, chosen by a hash of the id.

Priors of a document: the share of good documents of its site (host) shrunk towards the global share,
and that of its section (path) shrunk towards its site. Shares count known labels as they are
and calibrated evidence otherwise, over all documents; the strength of each shrinkage is estimated
by moments from how much the shares of that level vary beyond chance. A document's own evidence is
taken out of its section before it is judged by it. The score is the posterior from both.

One grouped sum each over sections and sites, with partial sums first; the joins back meet a large
site only on the side that Spark may split.

Defined results: null text is empty and has only its priors; a null host or path is a site or section of its
own; documents without a label are scored alike; repeated labels of an id count by their mean;
without labels every score is 0.5 (kept); without labels of both kinds the priors decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import written

SAMPLE = 40_000
BUCKET_BITS, GRAM = 16, 4
PIECE = 1 << 22
MIX = np.uint64(0x9E3779B97F4A7C15)


def _buckets(text: str | None) -> Iterator[np.ndarray]:
    data = (text or "").lower().encode("utf-8", "surrogatepass")
    for at in range(0, max(len(data) - GRAM + 1, 0), PIECE):
        a = np.frombuffer(data[at : at + PIECE + GRAM - 1], np.uint8).astype(np.uint64)
        h = a[:-3] | a[1:-2] << np.uint64(8) | a[2:-1] << np.uint64(16) | a[3:] << np.uint64(24)
        yield ((h * MIX) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gram counts of bad and good documents of this task."""
    totals = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for b in batches:
        for good, text in zip(b.column(0).to_pylist(), b.column(1)):
            for h in _buckets(text.as_py()):
                totals[int(good)] += np.bincount(h, minlength=1 << BUCKET_BITS)
    at = np.flatnonzero(totals.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[0][at]), pa.array(totals[1][at])], names=["bucket", "bad", "good"])


def _evidence(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(b.num_columns - 1):
                total, n = 0.0, 0
                for h in _buckets(text.as_py()):
                    total, n = total + float(weights[h].sum()), n + len(h)
                out.append(total / n if n else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, type=pa.float64())], names=[*b.schema.names[:-1], "evidence"])

    return run


def _logistic(rows: list[tuple[float, float, float]]) -> tuple[float, float]:
    """Slope and intercept for (evidence, bad, good) counts, by ridge-damped Newton steps."""
    x, bad, good = (np.array(c, dtype=float) for c in zip(*rows))
    scale = max(float(np.abs(x).max()), 1e-9)
    x, w = x / scale, np.zeros(2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (good - (good + bad) * p) - 0.01 * w
        hessian = (design * ((good + bad) * p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def _strength(rows: DataFrame, mean: Column) -> float:
    """How many documents the prior mean is worth: by moments of the groups' shares about it."""
    got = rows.select((F.col("s") / F.col("n") - mean).alias("e"), "n", mean.alias("m")).agg(
        F.sum(F.col("n") * F.col("e") * F.col("e")).alias("spread"), F.sum(F.col("m") * (1 - F.col("m"))).alias("chance"),
        F.sum("n").alias("n"), F.avg(F.col("m") * (1 - F.col("m"))).alias("v"),
    ).first()
    if not got["n"]:
        return 1.0
    between = (got["spread"] - got["chance"]) / got["n"]
    return float(min(max(got["v"] / between - 1, 1.0), 10_000.0)) if between > 0 else 10_000.0


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, doc_score (evidence alone), host_share, path_share, score and kept of every document."""
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.avg(F.col(label).cast("double")).alias("y"))
    known = written(known, "known")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)).cast("double") / 1_000_000
    sample = known.filter(place < min(1.0, SAMPLE / max(known.count(), 1))).withColumn("y", (F.col("y") >= 0.5).cast("int")).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)))
    base = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"),
        F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col(text).alias("text"),
    )
    # the sample has about SAMPLE rows of three numbers: small enough for every executor
    training = base.select("doc_id", "text").join(F.broadcast(sample.filter("fold > 0")), "doc_id").select("y", "text")
    totals = np.zeros((2, 1 << BUCKET_BITS))
    grams = training.mapInArrow(_count, "bucket long, bad long, good long").groupBy("bucket").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    for r in grams.collect():  # at most one row for each bucket
        totals[:, r["bucket"]] = r["bad"], r["good"]
    share = (totals + 1) / (totals.sum(axis=1, keepdims=True) + totals.shape[1])
    weights = np.log(share[1]) - np.log(share[0])
    scored = written(base.mapInArrow(_evidence(weights), "doc_id long, host string, path string, evidence double"), "evidence")
    bins = scored.join(F.broadcast(sample.filter("fold = 0")), "doc_id").groupBy(F.round("evidence", 2).alias("x"))
    rows = bins.agg(F.sum(1 - F.col("y")).alias("bad"), F.sum("y").alias("good")).collect()  # a mean log ratio to two digits: some thousand
    slope, intercept = _logistic([(r["x"], r["bad"], r["good"]) for r in rows]) if rows else (0.0, 0.0)
    p = 1 / (1 + F.exp(-(F.lit(slope) * F.col("evidence") + F.lit(intercept))))
    # labels are joined by id; both sides are tables, so a repeated id is split like any large key
    judged = scored.withColumn("doc_score", p).join(known, "doc_id", "left").withColumn("own", F.coalesce("y", "doc_score")).drop("y")
    judged = written(judged, "judged")
    sections = written(judged.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("own").alias("s")), "sections")
    sites = sections.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = sites.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = (whole["s"] + 1.0) / (whole["n"] + 2.0) if whole["n"] else 0.5
    to_global = _strength(sites, F.lit(mean))
    sites = written(sites.withColumn("host_share", (F.col("s") + to_global * mean) / (F.col("n") + to_global)).select("host", "host_share"), "sites")
    sections = sections.join(sites, "host")
    to_site = _strength(sections, F.col("host_share"))
    sections = written(sections.select("host", "path", "n", "s", "host_share"), "shares")
    out = judged.join(sections, ["host", "path"])
    path_share = (F.col("s") - F.col("own") + to_site * F.col("host_share")) / (F.col("n") - 1 + to_site)
    out = out.withColumn("path_share", path_share)
    logit = _logit(F.col("doc_score")) + _logit(F.col("path_share")) - math.log(mean / (1 - mean) if 0 < mean < 1 else 1.0)
    out = out.withColumn("score", 1 / (1 + F.exp(-logit)))
    return out.select("doc_id", "doc_score", "host_share", "path_share", "score", (F.col("score") >= 0.5).alias("kept"))
