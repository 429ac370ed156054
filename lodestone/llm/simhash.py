"""SimHash near-dedup with bit-sliced comparison.

Fingerprint: 64 bits; bit i is 1 if it is set in over half of the XXH64 hashes (seed 42) of a text's
three-word shingles, repeats included. Documents link at RADIUS or fewer differing bits.

Equal fingerprints are one node. Two within 3 bits agree on at least two of five blocks of bits, so
every pair of blocks is a table keyed by both blocks' bits, ten in all, and any link meets in at
least one bucket. A bucket's members are stored as vertical bit planes, one long integer for each
bit; for a member, the planes are added bit by bit into carry-save counters that hold all its
distances at once, and the rest of the planes are left as soon as all members exceed the radius.
Only links that join two parts of a bucket's forest leave it: at most members - 1, not all pairs.

A bucket of more than CHUNK members is cut into chunks, and each pair of chunks is a group of its
own, so no task holds more than two chunks of a bucket, and none is left out.

Defined results: null text has no words; texts without words have fingerprint zero and link like
any other; repeated rows come out each; an empty table gives an empty one; a very long text is hashed some
65,536 shingles at a time; a component's id is its smallest non-null doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.graph import components
from lodestone.llm.rows import unwrap, wrap
from lodestone.runtime import release, written

WIDTH, SEED, RADIUS, CHUNK = 3, 42, 3, 1024
EDGES = (0, 13, 26, 39, 52, 64)  # borders of the five blocks


def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    # bytes.lower() and bytes.split() know ASCII only, as asked
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(len(words) - width + 1, 1)
    digest = xxhash.xxh64_intdigest
    last = ends[min(width, len(words)) - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        hs = [digest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)].tolist(), last[at : at + (1 << 16)])]
        bits = np.unpackbits(np.array(hs, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns[:1], *b.columns[2:], pa.array(fps)], names=["doc_id", "k1", "k2", "fp"])


def with_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, k1 and k2 (keys of the row) and fp of every document."""
    keys = F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(text, F.lit(SEED)).alias("k2")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *keys)
    return rows.mapInArrow(_fingerprints, "doc_id long, k1 long, k2 long, fp long")


def planes(fps: np.ndarray) -> list[int]:
    """An integer for each bit; bit k of the i-th is bit i of the k-th fingerprint (a word of 64 bits, or a row of words)."""
    words = fps.shape[1] if fps.ndim > 1 else 1
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), 8 * words), axis=1, bitorder="little")
    packed = np.packbits(bits, axis=0, bitorder="little")
    return [int.from_bytes(packed[:, i].tobytes(), "little") for i in range(bits.shape[1])]


def near(fp: int, sliced: list[int], n: int, radius: int = RADIUS, order=range(64)) -> int:
    """Bit k is set if the k-th of n sliced fingerprints is within radius of fp."""
    everyone = (1 << n) - 1
    counters, far = [0] * radius.bit_length(), 0
    limit = (1 << len(counters)) - 1
    for step, i in enumerate(order):
        carry = sliced[i] ^ everyone if fp >> i & 1 else sliced[i]
        for c, v in enumerate(counters):
            counters[c], carry = v ^ carry, v & carry
        far |= carry
        if step & 3 == 3 and far == everyone:
            return 0
    for over in range(radius + 1, limit + 1):  # counts that fit the counters but not the radius
        hit = everyone
        for c, v in enumerate(counters):
            hit &= v if over >> c & 1 else v ^ everyone
        far |= hit
    return far ^ everyone


def forest(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS, order=range(64)) -> list[tuple[int, int]]:
    """Links that span what is linked among left, or between left and right."""
    fps = left if right is None else np.concatenate([left, right])
    base = 0 if right is None else len(left)
    sliced, n = planes(fps[base:]), len(fps) - base
    part, members = list(range(len(fps))), [1 << k for k in range(len(fps))]
    signed, out = fps.view(np.int64).tolist(), []
    for k, fp in enumerate(left.tolist()):
        hits = near(fp, sliced, n, radius, order) << base
        hits &= ~members[part[k]]
        while hits:
            other = (hits & -hits).bit_length() - 1
            out.append((signed[k], signed[other]))
            a, b = part[k], part[other]
            members[a] |= members[b]
            rest = members[b]
            while rest:  # relabel the part that was joined
                low = rest & -rest
                part[low.bit_length() - 1] = a
                rest ^= low
            hits &= ~members[a]
    return out


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None

        def edges(t: int, i: int, j: int, side: np.ndarray, fps: np.ndarray) -> list[tuple[int, int]]:
            x, y = TABLES[t]
            shared = {*range(EDGES[x], EDGES[x + 1]), *range(EDGES[y], EDGES[y + 1])}
            order = [b for b in range(64) if b not in shared]  # the shared bits cannot differ
            return forest(fps, None, radius, order) if i == j else forest(fps[side == 0], fps[side == 1], radius, order)

        def groups(cols, last: bool):
            keys = np.stack(cols[:4])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            bounds = [0, *cuts.tolist(), len(cols[0])]
            found: list[tuple[int, int]] = []
            stop = len(bounds) - 1 if last else len(bounds) - 2
            for a, b in zip(bounds[:stop], bounds[1 : stop + 1]):
                if b - a > 1:
                    found += edges(int(cols[0][a]), int(cols[2][a]), int(cols[3][a]), cols[4][a:b], cols[5][a:b].view(np.uint64))
            return found, bounds[stop]

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], type=pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = tuple(c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            if held is not None:
                cols = tuple(np.concatenate(x) for x in zip(held, cols))
            found, at = groups(cols, False)
            held = tuple(c[at:] for c in cols)  # the last group may go on in the next batch
            if found:
                yield out(found)
        if held is not None and len(held[0]) and (found := groups(held, True)[0]):
            yield out(found)

    return run


TABLES = tuple(combinations(range(len(EDGES) - 1), 2))


def _block(fp, k: int):
    return F.shiftrightunsigned(fp, EDGES[k]).bitwiseAND(F.lit((1 << (EDGES[k + 1] - EDGES[k])) - 1))


def links(nodes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) between distinct fingerprints that span all that are linked."""
    if radius > 3:
        raise ValueError("five blocks find links of up to three bits")
    fp = F.col("fp")
    keyed = nodes.select(
        "fp",
        F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.shiftleft(_block(fp, y), 13).bitwiseOR(_block(fp, x)).alias("key")) for t, (x, y) in enumerate(TABLES)))).alias("b"),
    ).select("fp", "b.t", "b.key")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    held = keyed.join(written(sizes, "sizes"), ["t", "key"]).withColumn("m", F.ceil(F.col("n") / chunk).cast("long"))
    own = held.withColumn("c", F.pmod(F.xxhash64("fp", "t"), F.col("m")))
    pairs = own.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    rows = pairs.select("t", "key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), (F.col("c") > F.col("o")).cast("int").alias("side"), "fp")
    by = ["t", "key", "i", "j"]
    return rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(_compare(radius), "a long, b long")


def cluster(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, k1, k2 (keys of the row), fp, fingerprint (hex), root and component_id of every document."""
    spark = docs.sparkSession
    prints = written(with_fingerprints(docs, doc_id, text), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = written(links(nodes.select("fp"), radius), "links")
    release(spark)
    roots = components(found).withColumnRenamed("node", "fp")
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = written(named.select("fp", "root").join(written(least, "least"), "root"), "ids")
    return prints.join(ids, "fp").select("*", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"))


def first_of_each(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The documents, all columns, one of each root of found (doc_id, k1, k2, root)."""
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("f"))
    first = first.select("f.k1", "f.k2")
    rows = wrap(docs, k1=F.xxhash64(doc_id, text), k2=F.xxhash64(text, F.lit(SEED)))
    return unwrap(rows.join(first, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]))


def deduplicate(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, one of each component: the smallest id (null last), of its rows one."""
    return first_of_each(docs, cluster(docs, radius, doc_id, text), doc_id, text)
