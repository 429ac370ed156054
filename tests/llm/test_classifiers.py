"""Language ID and the quality classifier."""

import math
import random
import zlib

import pytest

from lodestone.llm import language_id, quality_classifier
from lodestone.llm.queries import QUERIES
from nasty import nasty_rows
from pyspark.sql import functions as F


def test_held_out_accuracy(spark, sf):
    found = QUERIES["op5_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    test = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert sum(r.lang == r.lang_pred for r in test) >= 0.95 * len(test) and len(found) == len({r.doc_id for r in found})
    assert all(0 <= r.score <= 1 for r in found)


def test_language_is_that_of_the_smallest_encoding(spark, sf):
    """Against a plain loop: every text with every dictionary, piece by piece."""
    import regex
    import zstandard

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    learned = language_id.fit(docs.select("doc_id", "text", "lang"))
    got = {r.doc_id: (r.lang_pred, r.margin) for r in language_id.predict(docs, learned).collect()}
    how = {"dict_size": 0, "min_match": 3, "strategy": zstandard.STRATEGY_BTOPT, "write_checksum": 0, "write_content_size": 0}
    for doc, text in docs.select("doc_id", "text").collect():
        data = regex.sub(r"[^\p{L}\p{M}]+", " ", text or "").strip(" ").lower().encode()
        if not data:
            assert got[doc][0] == "und"
            continue
        sizes = []
        for name, words in learned.items():
            d = zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters.from_level(language_id.LEVEL, **how | {"dict_size": len(words)})
            d.precompute_compress(compression_params=p)
            pack = zstandard.ZstdCompressor(compression_params=p, dict_data=d).compress
            sizes.append((sum(len(pack(data[i : i + language_id.PIECE])) for i in range(0, len(data), language_id.PIECE)), name))
        ordered = sorted(sizes, key=lambda x: x[0])
        assert got[doc][0] == ordered[0][1] and got[doc][1] == pytest.approx(1 - ordered[0][0] / ordered[1][0])


def test_language_of_odd_rows(spark, nasty, nothing):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the house and the river", "en"), ("das haus und der fluss", "de")] * 20)] + [(None, "x", "en"), (99, "y", None)]
    learned = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(learned) == {"en", "de"}
    got = language_id.predict(nasty, learned).collect()
    assert len(got) == len(nasty_rows())
    by = {r.doc_id: r for r in got}
    assert all(by[d].lang_pred == "und" and by[d].score == 0 for d in (0, 1, 3)) and by[2].lang_pred in learned
    digits = spark.createDataFrame([(1, "123 456 !?")], "doc_id long, text string")
    assert language_id.predict(digits, learned).first().lang_pred == "und"
    assert language_id.predict(nothing, learned).count() == 0
    assert {r.lang_pred for r in language_id.predict(nasty, {}).collect()} == {"und"} and language_id.fit(nothing.select("doc_id", "text", "lang")) == {}


def test_sites_move_the_unsure_and_sparse_ones_are_shrunk(spark):
    r = random.Random(4)
    good, bad = "the quiet river walked home ", "buy $$$ click *** now "
    docs, labels = [], []
    for i in range(400):
        site = "good.com" if i % 2 else "bad.com"
        share = 0.9 if site == "good.com" else 0.1
        y = int(r.random() < share)
        docs.append((i, " ".join(r.choice((good if y else bad).split()) for _ in range(30)), site, "p"))
        if i < 300:
            labels.append((i, y))
    docs += [(1000, "", "good.com", "p"), (1001, "", "bad.com", "p"), (1002, "", "new.com", "p"), (1003, None, None, None)]
    got = {x.doc_id: x for x in quality_classifier.classify(
        spark.createDataFrame(docs, "doc_id long, text string, h string, q string"), spark.createDataFrame(labels, "doc_id long, quality int"), F.col("h"), F.col("q")).collect()}
    assert got[1000].score > 0.75 > 0.25 > got[1001].score
    assert got[1001].host_share < got[1002].host_share < got[1000].host_share
    known = dict(labels)
    assert sum((got[i].doc_score >= 0.5) == bool(y) for i, y in known.items()) >= 0.97 * len(known)


def test_posteriors_equal_a_plain_computation(spark):
    """Shares, their strengths by moments and scores, from the evidence that came out and the labels."""
    r = random.Random(11)
    docs, labels = [], {}
    for i in range(500):
        site, section = r.choice("abcd"), r.choice("xyz")
        y = int(r.random() < {"a": 0.9, "b": 0.6, "c": 0.4, "d": 0.1}[site])
        docs.append((i, " ".join(r.choice(["river", "home", "walk"] if y else ["buy", "click", "now"]) + str(r.randrange(5)) for _ in range(12)), site, section))
        if i % 3:
            labels[i] = y
    frame = spark.createDataFrame(docs, "doc_id long, text string, h string, q string")
    got = {x.doc_id: x for x in quality_classifier.classify(frame, spark.createDataFrame(list(labels.items()), "doc_id long, quality int"), F.col("h"), F.col("q")).collect()}
    own = {d: labels.get(d, got[d].doc_score) for d, *_ in docs}
    group = lambda key: {k: [own[x[0]] for x in docs if key(x) == k] for k in {key(x) for x in docs}}
    sites, sections = group(lambda x: x[2]), group(lambda x: x[2:])
    mean = (sum(own.values()) + 1) / (len(own) + 2)

    def strength(groups, prior):
        n = sum(map(len, groups.values()))
        v = [prior(k) * (1 - prior(k)) for k in groups]
        between = (sum(len(g) * (sum(g) / len(g) - prior(k)) ** 2 for k, g in groups.items()) - sum(v)) / n
        return min(max(sum(v) / len(v) / between - 1, 1.0), 10_000.0) if between > 0 else 10_000.0

    a = strength(sites, lambda k: mean)
    host = {k: (sum(g) + a * mean) / (len(g) + a) for k, g in sites.items()}
    b = strength(sections, lambda k: host[k[0]])
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    for d, _, h, q in docs:
        g = sections[h, q]
        path = (sum(g) - own[d] + b * host[h]) / (len(g) - 1 + b)
        score = 1 / (1 + math.exp(-(logit(got[d].doc_score) + logit(path) - math.log(mean / (1 - mean)))))
        assert (got[d].host_share, got[d].path_share, got[d].score) == pytest.approx((host[h], path, score), abs=1e-9)


def test_sites_help_on_labels_held_out(spark):
    """Where texts say little and sites much, the posteriors are right more often than the evidence alone."""
    r = random.Random(6)
    docs, truth = [], {}
    for i in range(1200):
        site = f"s{i % 30}"
        truth[i] = int(r.random() < (0.9 if i % 30 < 15 else 0.1))
        good = r.random() < (0.65 if truth[i] else 0.35)  # a text shows its label two times in three
        docs.append((i, " ".join(r.choice(["river", "home", "walk"] if good else ["buy", "click", "now"]) for _ in range(12)), site, "p"))
    learned = [(i, y) for i, y in truth.items() if i // 30 % 2]
    got = quality_classifier.classify(spark.createDataFrame(docs, "doc_id long, text string, h string, q string"), spark.createDataFrame(learned, "doc_id long, quality int"), F.col("h"), F.col("q")).collect()
    test = [x for x in got if x.doc_id // 30 % 2 == 0]
    alone, both = (sum((f(x) >= 0.5) == bool(truth[x.doc_id]) for x in test) / len(test) for f in (lambda x: x.doc_score, lambda x: x.score))
    assert both >= 0.7 and both >= alone + 0.05, (alone, both)


def test_quality_of_held_out_labels(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").dropDuplicates(["doc_id"])
    test = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    got = quality_classifier.classify(docs, labels.filter(~test), F.col("source"), F.col("lang"))
    rows = got.join(labels.filter(test), "doc_id").collect()
    assert len(rows) > 5 and sum(r.kept == bool(r.quality) for r in rows) >= 0.85 * len(rows)


def test_quality_on_the_tables(spark, sf):
    found = QUERIES["op7_quality_classifier"](spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = found.join(spark.read.parquet(f"{sf}/labels.parquet").dropDuplicates(["doc_id"]), "doc_id").collect()
    assert found.count() == n and sum(r.kept == bool(r.quality) for r in rows) >= 0.9 * len(rows)


def test_quality_of_odd_rows(spark, nasty, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (4, 1), (7, 1), (11, 0), (None, 1), (12, None)], "doc_id long, quality int")
    args = (F.col("source"), F.col("lang"))
    got = quality_classifier.classify(nasty, labels, *args).collect()
    assert len(got) == len(nasty_rows()) and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == pytest.approx(0.5) and r.kept for r in quality_classifier.classify(nasty, labels.limit(0), *args).collect())
    assert quality_classifier.classify(nothing, labels, *args).count() == 0
