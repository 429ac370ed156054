"""Line dedup: a line goes if an equal or nearly equal line stands earlier in the corpus.

Earlier means by (doc_id, null last; row key; line number). Lines with a word are compared; lines of
at least MIN_LENGTH characters also match within THRESHOLD edits (code points), shorter ones only
when equal. A line is removed if any earlier line matches it, removed or not, so of two lines that
stay none matches the other. Lines without a word always stay.

Segment-partition join: a line is cut into THRESHOLD + 1 segments; of two lines within THRESHOLD
edits, the longer one holds a segment of the shorter one unchanged, at a place that the difference
of their lengths and the segment's number limit to a few. So a line has a key for each of its own
segments and for each substring that could be a segment of an equally long or shorter line. Keys
are dealt out and read in order, and only keys that two different lines share come through, holding
one line at a time in memory. Their members are verified by bit-parallel edit distance within a
band of 2 * THRESHOLD + 1 diagonals; each diagonal is one long integer of mismatches.

A segment that more than HOT lines hold says little. These lines are cut once more, into THRESHOLD + 2 segments, of
which two at least are unchanged in any match, and meet at pairs of segments, half of a line, instead: two
lines that match and share hot segments only are both cut that way.

Equal lines are one line from the first step on: a task sends each line once, and what follows is
grouped by 128-bit line keys. A key's members beyond CHUNK are compared by pairs of chunks.

Defined results: null text has no lines to remove and stays null; rows that repeat id and text are
one document here and keep the same lines; an empty table gives an empty one; a very long text is cut into its
lines in one task; the other columns pass through unread.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.rows import ROW, slices, unwrap, wrap
from lodestone.runtime import discard, release, written

THRESHOLD, MIN_LENGTH, CHUNK, HOT = 2, 20, 512, 4096
SEEN = 200_000
_SEED = 97


def segments(length: int, count: int) -> list[tuple[int, int]]:
    """(start, length) of so many segments, the longer ones last."""
    size, more = divmod(length, count)
    out, at = [], 0
    for i in range(count):
        n = size + (i >= count - more)
        out.append((at, n))
        at += n
    return out


def probes(length: int, threshold: int, least: int) -> list[tuple[int, int, int]]:
    """(seed, start, length) of every substring of a line of this length that can be a segment."""
    out = set()
    for other in range(max(least, length - threshold), length + 1):
        extra = length - other
        for i, (p, n) in enumerate(segments(other, threshold + 1)):
            low = max(0, p - i, p + extra - (threshold - i))
            high = min(length - n, p + i, p + extra + (threshold - i))
            out.update((other * (threshold + 1) + i, at, n) for at in range(low, high + 1))
    return sorted(out)


def pairs_of_segments(length: int, threshold: int, least: int) -> list[tuple[int, int, int, int, int]]:
    """(seed, start, length, start, length) of all that can be two of threshold + 2 segments of a line: shifts that
    the edits before, between and after them can make."""
    out, count = set(), threshold + 2
    for other in range(max(least, length - threshold), length + 1):
        extra, parts = length - other, segments(other, count)
        for i in range(count):
            for j in range(i + 1, count):
                (p, n), (q, m) = parts[i], parts[j]
                for x in range(-threshold, threshold + 1):
                    for y in range(-threshold, threshold + 1):
                        if abs(x) + abs(y - x) + abs(extra - y) <= threshold and 0 <= p + x and p + x + n <= q + y and q + y + m <= length:
                            out.add(((other * count + i) * count + j, p + x, n, q + y, m))
    return sorted(out)


def within(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """Whether b is at most threshold edits from a; both are arrays of code points."""
    n, m = len(a), len(b)
    if abs(n - m) > threshold:
        return False
    misses: dict[int, int] = {}

    def slide(i: int, d: int) -> int:
        """The first mismatch at or after i on diagonal d, or its end."""
        if d not in misses:
            lo, hi = max(0, -d), min(n, m - d)
            bad = np.zeros(hi + 1, dtype=bool)
            bad[lo:hi] = a[lo:hi] != b[lo + d : hi + d]
            bad[hi] = True
            misses[d] = int.from_bytes(np.packbits(bad, bitorder="little").tobytes(), "little")
        rest = misses[d] >> i
        return i + (rest & -rest).bit_length() - 1

    reach = {0: slide(0, 0)}
    for e in range(threshold + 1):
        if reach.get(m - n, -1) >= n:
            return True
        if e == threshold:
            return False
        further: dict[int, int] = {}
        for d in range(-e - 1, e + 2):
            steps = [reach[d] + 1] if d in reach else []
            steps += [reach[d - 1]] if d - 1 in reach else []
            steps += [reach[d + 1] + 1] if d + 1 in reach else []
            i = min(max(steps, default=-1), n, m - d)
            if i >= max(0, -d):
                further[d] = slide(i, d)
        reach = further
    return False


def _lines(text: str | None) -> list[tuple[int, str]]:
    """Number and text of the lines that have a word."""
    return [(i, x) for i, x in enumerate(text.split("\n")) if x.strip(" \t\n\v\f\r")] if text else []


def _digest(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def _id(digest: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", digest)


LINES = "k1 long, k2 long, doc_id long, line int, h1 long, h2 long"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        rows = []
        for k1, k2, doc, text in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3)):
            rows += [(k1, k2, doc, i, *_id(_digest(x))) for i, x in _lines(text.as_py())]
        if rows:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=["k1", "k2", "doc_id", "line", "h1", "h2"])


def _new_lines(column, seen: set, least: int) -> Iterator[tuple[tuple[int, int], str]]:
    """Long enough lines that this task has not met; a full memory only means some come again."""
    for text in column:
        for _, x in _lines(text.as_py()):
            if len(x) >= least and (d := _digest(x)) not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(d)
                yield _id(d), x


def _keys(threshold: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        plans: dict[int, list[tuple[int, int, int]]] = {}
        for b in slices(batches):
            keys: list[int] = []
            ids: list[int] = []
            for (h, _), x in _new_lines(b.column(0), seen, least):
                n = len(x)
                if n not in plans:
                    if len(plans) > 20_000:
                        plans.clear()
                    plans[n] = probes(n, threshold, least)
                data = x.encode("utf-32-le", "surrogatepass")
                keys += [xxhash.xxh3_64_intdigest(data[4 * at : 4 * (at + size)], seed) for seed, at, size in plans[n]]
                ids += [h] * len(plans[n])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, dtype=np.uint64).view(np.int64)), pa.array(ids, type=pa.int64())], names=["key", "id"])

    return run


def _pair_keys(threshold: int, least: int):
    """Rows (id, text): a key for each pair of segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys: list[int] = []
            ids: list[int] = []
            for h, x in zip(*(c.to_pylist() for c in b.columns)):
                plan = pairs_of_segments(len(x), threshold, least)
                data = x.encode("utf-32-le", "surrogatepass")
                # other seeds than those of single segments have
                keys += [xxhash.xxh3_64_intdigest(data[4 * p : 4 * (p + n)] + data[4 * q : 4 * (q + m)], (1 << 62) + seed) for seed, p, n, q, m in plan]
                ids += [h] * len(plan)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, dtype=np.uint64).view(np.int64)), pa.array(ids, type=pa.int64())], names=["key", "id"])

    return run


def _met(keys: DataFrame) -> DataFrame:
    """The distinct rows (key, id) of keys that two lines share."""
    return keys.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_shared, "key long, id long")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of (key, id): the distinct rows of keys with two ids or more."""
    last: tuple[int, int] | None = None  # the last row, and whether its key has been given out
    given = False
    for b in batches:
        key, ids = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        if not len(key):
            continue
        if last is not None:
            key, ids = np.concatenate([[last[0]], key]), np.concatenate([[last[1]], ids])
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])])
        key, ids = key[new], ids[new]
        same = key[1:] == key[:-1]
        out = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        if last is not None:
            carried, first = given, bool(same[0]) if len(same) else False
            out[0] = first and not carried
            given = (carried or first) if (key == key[0]).all() else bool(out[-1])
        else:
            given = bool(out[-1])
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(ids[out])], names=["key", "id"])
        last = (int(key[-1]), int(ids[-1]))


def _texts(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b in slices(batches):
            rows = [(*h, x) for h, x in _new_lines(b.column(0), seen, least)]
            if rows:
                types = [pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=["h1", "h2", "text"])

    return run


def _verify(threshold: int):
    """Groups (key, i, j) of rows (side, rank columns, h1, h2, text): lines with an earlier match."""

    def later(group: list[tuple], cross: bool) -> list[tuple[int, int]]:
        group.sort(key=lambda r: r[1])
        points = [np.frombuffer(r[4].encode("utf-32-le", "surrogatepass"), dtype="<u4") for r in group]
        out = []
        for y in range(1, len(group)):
            for x in range(y):
                if (not cross or group[x][0] != group[y][0]) and within(points[x], points[y], threshold):
                    out.append(group[y][2:4])
                    break
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []
        for b in batches:
            out = []
            cols = [c.to_pylist() for c in b.columns]
            for key, i, j, side, none, doc, k1, k2, line, h1, h2, text in zip(*cols):
                if (key, i, j) != now:
                    if len(group) > 1:
                        out += later(group, now[1] != now[2])
                    now, group = (key, i, j), []
                group.append((side, (none, doc or 0, k1, k2, line), h1, h2, text))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], type=pa.int64()) for k in (0, 1)], names=["h1", "h2"])
        if len(group) > 1 and (out := later(group, now[1] != now[2])):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], type=pa.int64()) for k in (0, 1)], names=["h1", "h2"])

    return run


def find(docs: DataFrame, threshold: int = THRESHOLD, min_length: int = MIN_LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(k1, k2, line, near) of every line to remove; near is false if an equal line stands earlier."""
    if min_length <= threshold:
        raise ValueError("lines must be longer than the threshold")
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    keys = F.xxhash64("doc_id", "text"), F.xxhash64("text", F.lit(_SEED))
    lines = written(base.select(*keys, "doc_id", "text").mapInArrow(_occurrences, LINES), "lines")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2", "line")
    firsts = written(lines.groupBy("h1", "h2").agg(F.min(order).alias("first")), "firsts")
    release(spark)
    dealt = base.select("text").mapInArrow(_keys(threshold, min_length), "key long, id long")
    shared = written(_met(dealt), "shared")
    release(spark)
    ids = shared.select(F.col("id").alias("h1")).distinct()
    texts = base.select("text").mapInArrow(_texts(min_length), "h1 long, h2 long, text string").join(ids, "h1", "left_semi")
    texts = texts.groupBy("h1", "h2").agg(F.first("text").alias("text")).join(firsts, ["h1", "h2"])
    texts = written(texts.select("h1", "h2", "text", "first.*"), "texts")
    release(spark)
    shared = _cooled(shared, texts, threshold, min_length)
    sizes = written(shared.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).alias("m")), "sizes")
    chunked = shared.join(sizes, "key").withColumn("c", F.pmod(F.xxhash64("id", "key"), F.col("m")))
    pairs = chunked.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    pairs = pairs.select("key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), (F.col("c") > F.col("o")).cast("int").alias("side"), F.col("id").alias("h1"))
    rows = pairs.join(texts, "h1").select("key", "i", "j", "side", F.col("none").cast("int").alias("none"), "doc_id", "k1", "k2", "line", "h1", "h2", "text")
    by = ["key", "i", "j"]
    near = rows.repartition(*by).sortWithinPartitions(*by).mapInArrow(_verify(threshold), "h1 long, h2 long").distinct()
    judged = written(firsts.join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near")), "judged")
    discard(firsts)
    release(spark)
    lost = lines.join(judged, ["h1", "h2"]).filter(F.col("near") | (order != F.col("first")))
    lost = written(lost.select("k1", "k2", "line", (order == F.col("first")).alias("near")), "lost")
    for t in (lines, shared, sizes, texts, judged):
        discard(t)
    release(spark)
    return lost


def _cooled(shared: DataFrame, texts: DataFrame, threshold: int, least: int) -> DataFrame:
    """shared, with hot keys replaced by pairs of segments of their lines."""
    hot = written(shared.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("key"), "hot")
    if not hot.limit(1).count():
        discard(hot)
        return shared
    ids = shared.join(hot, "key", "left_semi").select(F.col("id").alias("h1")).distinct()
    lines = texts.join(written(ids, "hot-lines"), "h1", "left_semi").select(F.col("h1").alias("id"), "text")
    finer = written(_met(lines.mapInArrow(_pair_keys(threshold, least), "key long, id long")), "finer")
    cooled = written(shared.join(hot, "key", "left_anti").unionByName(finer), "cooled")
    for t in (shared, hot, finer):
        discard(t)
    return cooled


def apply(docs: DataFrame, lost: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document as one struct, with kept (the text left), n_lines and n_kept (lines with a word)."""
    lists = lost.groupBy("k1", "k2").agg(F.collect_set("line").alias("gone"))
    rows = wrap(docs, text=F.col(text), k1=F.xxhash64(F.col(doc_id).cast("long"), F.col(text)), k2=F.xxhash64(text, F.lit(_SEED)))
    rows = rows.join(lists, ["k1", "k2"], "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    rows = rows.select(ROW, "text", "gone", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    # without Python, as whole rows pass here; by set operations, so the work grows with the lines
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get("lines", i))
    kept = F.when(F.col("text").isNotNull(), F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(left, "\n")))
    worded = F.size(F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long")
    return rows.select(ROW, kept.alias("kept"), worded.alias("n_lines"), (worded - F.size("gone")).cast("long").alias("n_kept"))


def deduplicate(docs: DataFrame, threshold: int = THRESHOLD, min_length: int = MIN_LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, without their removed lines; those that lose all worded lines go."""
    cut = apply(docs, find(docs, threshold, min_length, doc_id, text), doc_id, text)
    return unwrap(cut.filter((F.col("n_kept") > 0) | (F.col("n_lines") == 0)), **{text: F.col("kept")})


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed, kept_sha256 (of the text left; null: empty)."""
    cut = apply(docs.select("doc_id", "text"), find(docs))
    return cut.select(
        F.col(f"{ROW}.doc_id").alias("doc_id"), "n_lines", (F.col("n_lines") - F.col("n_kept")).alias("n_removed"),
        F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )
