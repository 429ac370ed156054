"""Benchmark decontamination by winnowing, in DataFrame operations only.

A fingerprint is the smallest hash among the K-word grams of every WINDOW consecutive gram
positions. A shared span of K + WINDOW - 1 = 13 words holds one whole window, in which both texts
keep the same gram, so every 13-word match yields at least one joined fingerprint. Each joined
fingerprint is extended left and right word by word, on the words themselves; runs of 13 words or
more are hits. The test side keeps all positions of a kept hash, so ties cannot misalign it.

Up to BLOCK test fingerprints are broadcast with their words. Of more, only hashes are broadcast, HASHES at a
time, and the few probes that they let through meet the items in a shuffle, with SPAN words around them. So
what is broadcast has a fixed bound, and test sets beyond HASHES fingerprints cost further passes over the
documents instead of memory. Test items below 13 words are one window each and join on the hash of that
window at every position, in the same way.

Documents flow through one stage (scan, fingerprints, broadcast join, extension); a shuffle
carries one small row per document and one per matched run, grouped by document. The work on a text grows
with its length; a very long one is one row, whose words and hashes one task holds.

Defined results: null or wordless text has no words and is never hit; a wordless item is ignored; a
null item id counts for hits and not for n_items; repeated rows are kept and judged alike; an empty
table of items leaves every document clean; all other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.quality_rules import let
from lodestone.llm.rows import unwrap, wrap
from lodestone.runtime import written

SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPAN = 13
K = 5
WINDOW = SPAN - K + 1
POS_BITS = 30
BLOCK, HASHES = 100_000, 2_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SPLIT), "")


def _grams(words: Column, k: int) -> Column:
    """For each gram: the upper bits of its hash, then its position."""
    return F.transform(
        F.slice(words, 1, F.greatest(F.size(words) - (k - 1), F.lit(0))),
        lambda w, i: F.shiftleft(F.shiftright(F.xxhash64(w, *(F.get(words, i + j) for j in range(1, k))), POS_BITS), POS_BITS).bitwiseOR(i.cast("long")),
    )


def _least(grams: Column) -> Column:
    """The smallest of every WINDOW grams, by doubling the width."""
    out, width = grams, 1

    def shifted(by: int):
        return lambda a: F.transform(a, lambda x, i: F.least(x, F.get(a, i + by)))

    while width * 2 <= WINDOW:
        out = let(out, shifted(width))
        width *= 2
    if width < WINDOW:
        out = let(out, shifted(WINDOW - width))
    return F.slice(out, 1, F.greatest(F.size(grams) - (WINDOW - 1), F.lit(0)))


def fingerprints(words: Column) -> Column:
    """Distinct kept grams of a word array: hash in the upper bits, position in the lower."""
    return let(words, lambda w: let(_grams(w, K), lambda g: F.array_distinct(_least(g))))


def _hash(packed: Column) -> Column:
    return F.shiftright(packed, POS_BITS)


def _pos(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << POS_BITS) - 1)).cast("int")


def item_index(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Rows (size, fp, item, left, mid, right): kept grams with SPAN - K words of context, or whole short items."""
    base = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("w"))
    long = (
        base.filter(F.size("w") >= SPAN)
        .withColumn("g", _grams(F.col("w"), K))
        .withColumn("kept", F.array_distinct(F.transform(fingerprints(F.col("w")), _hash)))
        .select("item", "w", "kept", F.explode("g").alias("p"))
        .filter(F.array_contains("kept", _hash(F.col("p"))))
        .withColumn("i", _pos(F.col("p")))
    )
    reach = SPAN - K
    lead = F.least(F.col("i"), F.lit(reach))
    long = long.select(
        F.lit(K).alias("size"),
        _hash(F.col("p")).alias("fp"),
        "item",
        F.slice("w", F.col("i") - lead + 1, lead).alias("left"),
        F.slice("w", F.col("i") + 1, K).alias("mid"),
        F.slice("w", F.col("i") + K + 1, reach).alias("right"),
    )
    short = base.filter((F.size("w") > 0) & (F.size("w") < SPAN))
    none = F.array().cast("array<string>")
    short = short.select(
        (-F.size("w")).alias("size"),
        F.aggregate(F.slice("w", 2, SPAN), F.xxhash64(F.get("w", F.lit(0))), lambda a, x: F.xxhash64(a, x)).alias("fp"),
        "item",
        none.alias("left"),
        F.col("w").alias("mid"),
        none.alias("right"),
    )
    return long.union(short).distinct()


def _short_grams(words: Column, size: int) -> Column:
    def of(w: Column) -> Column:
        def fold(x: Column, i: Column) -> Column:
            h = F.xxhash64(x)
            for j in range(1, size):
                h = F.xxhash64(h, F.get(w, i + j))
            return F.struct(h.alias("h"), i.alias("i"))

        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - (size - 1), F.lit(0))), fold)

    return let(words, of)


def _run(same: Column) -> Column:
    """How many leading trues."""
    at = F.array_position(same, False)
    return F.when(at == 0, F.size(same)).otherwise(at - 1).cast("int")


def scan(docs: DataFrame, items: DataFrame, block: int = BLOCK, hashes: int = HASHES) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, n_hit, spans, items."""
    index = item_index(items)
    sizes = {r["size"]: r["n"] for r in index.groupBy("size").agg(F.count("*").alias("n")).collect()}
    base = docs.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("w")
    ).withColumn("n_words", F.size("w").cast("long"))
    parts = []
    for size, n in sorted(sizes.items(), reverse=True) or [(K, 0)]:
        width = abs(size)
        if size > 0:
            probes = F.transform(fingerprints(F.col("w")), lambda p: F.struct(_hash(p).alias("h"), _pos(p).alias("i")))
        else:
            probes = _short_grams(F.col("w"), width)
        blocks = 1 if n <= block else -(-n // hashes)
        for b in range(blocks):
            first = not parts
            mine = index.filter((F.col("size") == size) & (F.pmod("fp", F.lit(blocks)) == b)).drop("size")
            if first:  # a null probe takes every document through, once a row
                probes = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), probes)
            # exploded as a column of its own, so that generated code hands the words on to the join without a copy for
            # each probe; outer, as Spark would else filter by the size of the list, and make it twice
            rows = base.withColumn("ps", probes).select("doc_id", "text_hash", "n_words", "w", F.explode_outer("ps").alias("p"))
            rows = rows.withColumn("at", F.col("p.i")).withColumn("fp", F.col("p.h")).drop("p")
            how = "left" if first else "inner"
            if n <= block:
                rows = rows.join(F.broadcast(mine), "fp", how).withColumn("c", F.col("at"))
            else:
                known = mine.select("fp").distinct().withColumn("known", F.lit(True))
                rows = rows.join(F.broadcast(known), "fp", how).filter(F.col("fp").isNull() | F.col("known"))
                lead = F.least("at", F.lit(SPAN))
                around = F.slice("w", F.col("at") - lead + 1, lead + width + SPAN)
                # null probes, one a document, are dealt out by document
                key = F.coalesce("fp", F.xxhash64("doc_id", "text_hash"))
                rows = rows.select("doc_id", "text_hash", "n_words", "at", "fp", lead.alias("c"), around.alias("w"), key.alias("key"))
                rows = rows.join(mine.withColumnRenamed("fp", "found"), (F.col("key") == F.col("found")) & F.col("fp").isNotNull(), how)
            if first:
                rows = rows.filter(F.col("fp").isNull() | F.col("mid").isNotNull())
            parts.append(_extend(rows))
    found = reduce(DataFrame.union, parts)
    grouped = found.groupBy("doc_id", "text_hash", "n_words").agg(
        F.collect_set(F.when(F.col("ok"), F.struct("from", "to"))).alias("spans"),
        F.collect_set(F.when(F.col("ok"), F.col("item"))).alias("items"),
        F.sum("copies").alias("copies"),
    )
    merged = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["to"] - F.greatest(s["from"], a["end"]), F.lit(0))).alias("n"),
            F.greatest(a["end"], s["to"]).alias("end"),
        ),
    )["n"]
    # repeated rows meet in one group; as many rows come out again
    return grouped.withColumn("n_hit", merged).select(
        "doc_id", "text_hash", "n_words", "n_hit", "spans", F.array_sort("items").alias("items"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


def _extend(rows: DataFrame) -> DataFrame:
    """Hits of joined probes: fp stands at word `at` of the text, and at word c of w."""
    w, at, c, mid = F.col("w"), F.col("at"), F.col("c"), F.col("mid")

    def left_of(x: Column, j: Column) -> Column:
        return F.coalesce(x == F.get(w, c - 1 - j), F.lit(False))

    def right_of(x: Column, j: Column) -> Column:
        return F.coalesce(x == F.get(w, c + F.size(mid) + j), F.lit(False))

    n = F.size(mid)
    whole = F.forall(F.transform(mid, lambda x, j: F.coalesce(x == F.get(w, c + j), F.lit(False))), lambda b: b)
    rows = rows.withColumn("l", _run(F.transform(F.reverse("left"), left_of))).withColumn("r", _run(F.transform(F.col("right"), right_of)))
    need = F.when((n == K) & (F.size("left") + F.size("right") > 0), F.lit(SPAN)).otherwise(n)
    return rows.select(
        "doc_id", "text_hash", "n_words", "item",
        F.coalesce(whole & (F.col("l") + n + F.col("r") >= need), F.lit(False)).alias("ok"),
        (at - F.col("l")).alias("from"),
        (at + n + F.col("r")).alias("to"),
        F.col("fp").isNull().cast("int").alias("copies"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, share: int = 20) -> DataFrame:
    """The documents (all their columns) without the contaminated ones."""
    bad = scan(docs, items).filter(contaminated(share)).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    bad = written(bad, "contaminated")  # of known size: where it is small the documents are not shuffled
    rows = wrap(docs, id=F.col("doc_id"), hash=F.xxhash64("text"))
    same = F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("hash") == F.col("bad_hash"))
    return unwrap(rows.join(bad, same, "left_anti"))


def contaminated(share: int = 20) -> Column:
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
