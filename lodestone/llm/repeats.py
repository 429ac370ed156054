"""Units (bytes or words) covered by a string of SPAN units that also starts anywhere else.

Documents are written in blocks, and strings at all positions of a block get names (hashes). Which names occur
elsewhere is counted in Spark:

1. a block sorts the names of PIECE positions at a time, drops repeats, and sends them out in groups by their
   upper bits, as differences of five bytes or so; a string that a third of all documents share is one
   name from each piece;
2. the task that gets a group finds the names that two pieces sent, and sends each piece one bit a name;
3. the block names its positions again, reads the bits, and keeps the positions whose string is repeated.

Bytes are ranked by prefix doubling (see suffix_dedup): a name of 2m bytes at i is made from the pair of names at
i and i + m; positions whose name is found once are left out of the next round; the last offset is the one
that reaches the span. Words have one round: the Rabin-Karp sums of every window (see substring_dedup). A
last round counts an independent second name of the span. A string that is found once is taken for repeated
only if its name collides in every round: at 100 TB, with names of 64 bits, that is one window of words in 10 ** 12,
and with 56 bits in the four rounds of bytes one in 10 ** 13.

A group has some PER_GROUP names until there are MOST_GROUPS groups; beyond 10 ** 11 names a group, and the
memory of the task that counts it, grows with the input instead (MOST_GROUPS trades that for more rows).

Defined results: null text is empty; a document shorter than the span has nothing to remove; of repeated rows
each is a document of its own, so both lose what they share; matches never cross documents; an empty table
gives an empty one; a very long text is a block of its own, in pieces, whose task holds a few times its
size; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.rows import slices, unwrap, wrap
from lodestone.runtime import discard, release, written

POS_BITS = 24
POS_MASK = np.uint64((1 << POS_BITS) - 1)
BLOCK = PIECE = 1 << 21
GROUP_BLOCKS = 2
PER_GROUP, LEAST_GROUPS, MOST_GROUPS = 1 << 20, 1 << 10, 1 << 17
CHUNK = 1 << 16
_RNG = np.random.default_rng(20240501)
_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], dtype=np.uint64) | np.uint64(1)
_INVERSE = np.array([pow(int(b), -1, 1 << 64) for b in _BASES], dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def doubled(names: np.ndarray, size: int, which: int) -> np.ndarray:
    """Names of all strings of `size` symbols, each from the pair of names at its start and at a growing offset."""
    m = 1
    while m < size:
        step = min(m, size - m)
        pair = names[:-step] * _BASES[which]
        pair += names[step:]
        pair ^= pair >> np.uint64(32)
        pair *= np.uint64(0xD6E8FEB86659FD93)
        names, m = pair, m + step
    return names ^ (names >> np.uint64(29))


class Bytes:
    """Texts as UTF-8 bytes, one after the other."""

    bits = 56

    def __init__(self, texts: list[str | None]):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def names(self, size: int, which: int, a: int, z: int) -> np.ndarray:
        """Names of the strings at a..z; those that pass the end of the block mean nothing."""
        out = np.zeros(z - a, np.uint64)
        for at in range(a, z, CHUNK):
            end = min(z, at + CHUNK)
            got = doubled(_TABLE[self.data[at : end + size - 1]], size, which)
            out[at - a : at - a + len(got)] = got[: end - at]
        return out

    def kept(self, k: int, gone: np.ndarray) -> bytes:
        return self.data[self.bounds[k] : self.bounds[k + 1]][~gone].tobytes()


class Words:
    """Texts as words between white space, unchanged; names are Rabin-Karp sums over mixed hashes of words."""

    bits = 64

    def __init__(self, texts: list[str | None]):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.data = b"\n".join(parts)
        data = np.frombuffer(self.data, np.uint8)
        word = np.concatenate([[False], ~_SPACE[data], [False]])
        self.starts = np.flatnonzero(word[1:-1] & ~word[:-2])
        self.ends = np.flatnonzero(word[1:-1] & ~word[2:]) + 1
        borders = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)])
        self.bounds = np.searchsorted(self.starts, borders)
        self._sums: dict[int, np.ndarray] = {}

    def symbols(self) -> np.ndarray:
        """A hash of each word, from prefix sums over its bytes; some CHUNK words at a time."""
        out = [np.zeros(0, np.uint64)]
        data = np.frombuffer(self.data, np.uint8)
        for i in range(0, len(self.starts), CHUNK):
            starts, ends = self.starts[i : i + CHUNK], self.ends[i : i + CHUNK]
            piece = _TABLE[data[starts[0] : ends[-1]]]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(piece * _powers(_BASES[1], len(piece)), dtype=np.uint64)])
            starts, ends = starts - starts[0], ends - starts[0]
            h = (sums[ends] - sums[starts]) * _powers(_INVERSE[1], len(piece) + 1)[starts]
            out.append(_mix(h + (ends - starts).astype(np.uint64) * _BASES[0]))
        return np.concatenate(out)

    def names(self, size: int, which: int, a: int, z: int) -> np.ndarray:
        n = len(self.starts)
        if which not in self._sums:
            h = _mix(self.symbols() + np.uint64(which)) * _powers(_BASES[which], n)
            self._sums[which] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])
        sums, at = self._sums[which], np.arange(a, z)
        return _mix((sums[np.minimum(at + size, n)] - sums[at]) * _powers(_INVERSE[which], z)[a:])

    def kept(self, k: int, gone: np.ndarray) -> bytes:
        a, z = self.bounds[k], self.bounds[k + 1]
        if a == z:
            return b""
        # bytes.split() splits at exactly the six characters
        return b" ".join(compress(self.data[self.starts[a] : self.ends[z - 1]].split(), (~gone).tolist()))


UNITS = {"bytes": Bytes, "words": Words}


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    padded[:n] = x
    rows = padded.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def anchors(seq: Bytes, span: int, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs of windows that have one anchor: first and last window start, and the gram's hash. The anchor is the
    gram of `key` bytes with the least hash in the window, the leftmost of them; equal windows have equal anchors."""
    parts = []
    n = len(seq.data)
    for base in range(0, max(n - span + 1, 0), PIECE):
        end = min(n, base + PIECE + span - 1)
        h = seq.names(key, 0, base, end - key + 1)
        least = _sliding_least((h & ~POS_MASK) | np.arange(len(h), dtype=np.uint64), span - key + 1)
        at = (least & POS_MASK).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
        last = np.concatenate([first[1:] - 1, [len(at) - 1]])
        parts.append((first + base, last + base, h[at[first]].view(np.int64)))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*parts)) if parts else (none, none, none)


def _scan(span: int, key: int):
    """A row for each run of windows with one anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in slices(batches):
                found = [(np.zeros(0, np.int64),) * 5]
                for k1, k2, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    lo, hi, g = anchors(Bytes([text.as_py()]), span, key)
                    found.append((np.full(len(lo), k1, np.int64), np.full(len(lo), k2, np.int64), lo, hi, g))
                arrays = [pa.array(np.concatenate(x)) for x in zip(*found)]
                yield pa.RecordBatch.from_arrays(arrays, names=["k1", "k2", "lo", "hi", "gram"])

    return run


BLOCKS = "block long, n long, k1 array<long>, k2 array<long>, doc_id array<long>, text array<string>, open binary"


def _packed(unit: str):
    """Rows (k1, k2, doc_id, text, ranges) in blocks; ranges are the window starts to begin with, null for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        rows, size, made = [], 0, 0
        i64 = pa.int64()
        types = [i64, i64, pa.list_(i64), pa.list_(i64), pa.list_(i64), pa.list_(pa.string()), pa.binary()]
        names = [x.split()[0] for x in BLOCKS.split(", ")]

        def block() -> pa.RecordBatch:
            k1, k2, doc, texts, ranges = zip(*rows)
            seq, start = UNITS[unit](list(texts)), None
            if any(r is not None for r in ranges):
                marks = np.zeros(int(seq.bounds[-1]) + 1, np.int32)
                for at, r in zip(seq.bounds.tolist(), ranges):
                    for x in r or ():
                        marks[at + x["lo"]] += 1
                        marks[at + x["hi"] + 1] -= 1
                start = np.packbits(np.cumsum(marks[:-1]) > 0, bitorder="little").tobytes()
            row = [[base + made], [int(seq.bounds[-1])], [k1], [k2], [doc], [texts], [start]]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(row, types)], names=names)

        with np.errstate(over="ignore"):
            for b in slices(batches):
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    long = len(row[3] or "")
                    if rows and size + long > BLOCK:
                        yield block()
                        rows, size, made = [], 0, made + 1
                    rows.append(row)
                    size += long
            if rows:
                yield block()

    return run


def _valid(seq, span: int) -> np.ndarray:
    """Positions where a window of the span fits in the document."""
    ends = seq.bounds[1:]
    marks = np.zeros(int(ends[-1]) + 1, np.int32)
    np.add.at(marks, np.maximum(ends - span + 1, seq.bounds[:-1]), 1)
    np.add.at(marks, ends, -1)
    return np.cumsum(marks[:-1]) == 0


def _named(seq, which: tuple[int, int], a: int, z: int) -> np.ndarray:
    return seq.names(*which, a, z) >> np.uint64(64 - seq.bits)


def _borders(seq, once: np.ndarray, groups: int) -> np.ndarray:
    """Where the names of each group begin among sorted ones."""
    return np.searchsorted(once >> np.uint64(seq.bits - (groups - 1).bit_length()), np.arange(groups + 1, dtype=np.uint64))


def _alive(seq, span: int, done: tuple[int, int] | None, start: bytes | None, state: list | None, groups: int) -> np.ndarray:
    """Positions whose string is repeated as far as is known: after a round, those whose bit it sent back."""
    n = int(seq.bounds[-1])
    out = _valid(seq, span)
    if done is None:
        return out & np.unpackbits(np.frombuffer(start, np.uint8), bitorder="little", count=n).astype(bool) if start is not None else out
    out[:] = False
    pieces: dict[int, dict[int, bytes]] = {}
    for s in state or ():
        pieces.setdefault(s["piece"], {})[s["grp"]] = s["bits"]
    for p, bits in pieces.items():
        a, z = p * PIECE, min(n, (p + 1) * PIECE)
        at = np.flatnonzero(np.unpackbits(np.frombuffer(bits[min(bits)], np.uint8), bitorder="little", count=z - a))
        x = _named(seq, done, a, z)[at]
        order = np.argsort(x)
        x = x[order]
        new = np.concatenate([[True], x[1:] != x[:-1]])
        first = np.flatnonzero(new)
        repeated = np.diff(np.append(first, len(x))) > 1
        cuts = _borders(seq, x[first], groups)
        for g, b in bits.items():
            if g >= 0:
                repeated[cuts[g] : cuts[g + 1]] |= np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little", count=int(cuts[g + 1] - cuts[g])).astype(bool)
        out[a + at[order]] = repeated[np.cumsum(new) - 1]
    return out


SENT = "block long, piece int, grp int, bits binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=["block", "piece", "grp", "bits"])


def _send(unit: str, span: int, done: tuple[int, int] | None, now: tuple[int, int], groups: int):
    """The names of a round at the positions still open, by groups, and which positions those are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in slices(batches, 1):
                block, texts, start, state = (c.to_pylist()[0] for c in b.columns)
                seq = UNITS[unit](texts)
                alive = _alive(seq, span, done, start, state, groups)
                for p in range(-(-len(alive) // PIECE)):
                    a, z = p * PIECE, min(len(alive), (p + 1) * PIECE)
                    here = alive[a:z]
                    if not here.any():
                        continue
                    x = np.sort(_named(seq, now, a, z)[here])
                    x = x[np.concatenate([[True], x[1:] != x[:-1]])]
                    cuts = _borders(seq, x, groups)
                    full = np.flatnonzero(np.diff(cuts))
                    # the first name of a group as it is, the others less the one before
                    steps = np.diff(x, prepend=np.uint64(0))
                    steps[cuts[full]] = x[cuts[full]]
                    steps = steps.astype("<u8").view(np.uint8).reshape(-1, 8)
                    width = max(1, next((w for w in range(8, 0, -1) if steps[:, w - 1].any()), 1))
                    inner = np.ones(len(x), bool)
                    inner[cuts[full]] = False
                    used = next((w for w in range(width, 0, -1) if steps[inner, w - 1].any()), 1)
                    rows = [(block, p, -1 - int(block % groups), np.packbits(here, bitorder="little").tobytes())]
                    for g in full.tolist():
                        s = steps[cuts[g] : cuts[g + 1]]
                        rows.append((block, p, g, s[0].tobytes() + bytes([used]) + s[1:, :used].tobytes()))
                    yield _batch(rows)

    return run


def _names(blob: bytes) -> np.ndarray:
    used = blob[8]
    rest = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, used)
    steps = np.zeros((len(rest) + 1, 8), np.uint8)
    steps[0] = np.frombuffer(blob[:8], np.uint8)
    steps[1:, :used] = rest
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of grp: for each piece, which of its names another piece has sent too."""
    now, held = None, []

    def counted() -> list[tuple]:
        if len(held) < 2:
            return []
        parts = [_names(x[3]) for x in held]
        x = np.concatenate(parts)
        order = np.argsort(x)
        same = x[order[1:]] == x[order[:-1]]
        twice = np.zeros(len(x), bool)
        twice[order[1:]] = same
        twice[order[:-1]] |= same
        cuts = np.cumsum([0] + [len(y) for y in parts]).tolist()
        return [(*row[:3], np.packbits(twice[a:z], bitorder="little").tobytes()) for row, a, z in zip(held, cuts, cuts[1:]) if twice[a:z].any()]

    for b in slices(batches, 4096):
        out = []
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if row[2] < 0:
                out.append(row)
                continue
            if row[2] != now:
                out += counted()
                now, held = row[2], []
            held.append(row)
        if out:
            yield _batch(out)
    if out := counted():
        yield _batch(out)


CUT = "k1 long, k2 long, doc_id long, n_units long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _cut(unit: str, span: int, done: tuple[int, int], groups: int):
    """What each document of a block loses, and the text that is left (null where all stays)."""
    names = [x.split()[0] for x in CUT.split(", ")]
    types = [pa.int64()] * 6 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in slices(batches, 1):
                texts, state, *ids = (c.to_pylist()[0] for c in b.columns)
                seq = UNITS[unit](texts)
                upto = np.concatenate([np.zeros(span, np.int64), np.cumsum(_alive(seq, span, done, None, state, groups))])
                gone = upto[span:] > upto[:-span]
                bounds, rows = seq.bounds.tolist(), []
                for k, (k1, k2, doc) in enumerate(zip(*ids)):
                    mine = gone[bounds[k] : bounds[k + 1]]
                    runs = int(np.count_nonzero(mine[1:] & ~mine[:-1]) + mine[:1].sum())
                    left = seq.kept(k, mine)
                    # a byte span may cut a character: what is left of it shows as a replacement character
                    rows.append((k1, k2, doc, len(mine), int(mine.sum()), runs, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace") if runs else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def _keyed(docs: DataFrame, span: int, doc_id: str, text: str) -> DataFrame:
    return docs.select(
        F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(text, F.lit(span)).alias("k2"),
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
    )


def _rounds(unit: str, span: int, key: int | None) -> list[tuple[int, int]]:
    """(size, which name) of each round."""
    sizes = [span]
    while key and 2 * key < span:
        key *= 2
        sizes.insert(-1, key)
    return [*((s, 0) for s in sizes), (span, 1)]


def _open(keyed: DataFrame, span: int, key: int) -> DataFrame:
    """The documents with windows whose anchor is found twice, and those windows: others cannot be repeated."""
    spark = keyed.sparkSession
    runs = written(keyed.select("k1", "k2", "text").mapInArrow(_scan(span, key), "k1 long, k2 long, lo long, hi long, gram long"), "anchors")
    # written, so that both sides of the join are dealt out by it and Spark can split a large gram
    twice = written(runs.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "twice")
    some = runs.join(twice, "gram", "left_semi").groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    some = written(some, "open")
    discard(runs)
    discard(twice)
    release(spark)
    return keyed.join(some, ["k1", "k2"]).select("k1", "k2", "doc_id", "text", "ranges")


def find(docs: DataFrame, unit: str, span: int, key: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """k1, k2 (keys of the row), doc_id, n_units, n_removed, n_spans, kept_sha256 and kept; of every document, or, with a key,
    of those with a window whose anchor of key units is found twice."""
    if unit == "bytes" and (key is None or key > span or key & (key - 1)):
        raise ValueError("key is a power of two within the span")
    spark = docs.sparkSession
    keyed = _keyed(docs, span, doc_id, text)
    if key:
        some = _open(keyed, span, key)
    else:
        some = keyed.withColumn("ranges", F.lit(None).cast("array<struct<lo:bigint,hi:bigint>>"))
    blocks = _blocks(some, unit)
    release(spark)
    n = blocks.agg(F.sum("n").alias("n")).first()["n"] or 0
    groups = min(MOST_GROUPS, max(LEAST_GROUPS, 1 << (n // PER_GROUP).bit_length()))
    state = done = None
    for now in _rounds(unit, span, key):
        found = _round(blocks, state, unit, span, done, now, groups)
        if state is not None:
            discard(state)
        state, done = found, now
        release(spark)  # the names of the round are shuffle files that nothing refers to any more
    last = _with(blocks, state, "left").select("text", "state", "k1", "k2", "doc_id")
    return last.mapInArrow(_cut(unit, span, done, groups), CUT)


def _blocks(rows: DataFrame, unit: str) -> DataFrame:
    """The rows in blocks, a few of them in each row group, however many a task makes."""
    return written(rows.mapInArrow(_packed(unit), BLOCKS), "blocks", GROUP_BLOCKS)


def _round(blocks: DataFrame, state: DataFrame | None, unit: str, span: int, done: tuple[int, int] | None, now: tuple[int, int], groups: int) -> DataFrame:
    """Which names of this round each piece shares with another, and the positions it has sent them for."""
    rows = blocks.withColumn("state", F.lit(None).cast("array<struct<piece:int,grp:int,bits:binary>>")) if state is None else _with(blocks, state, "inner")
    sent = rows.select("block", "text", "open", "state").mapInArrow(_send(unit, span, done, now, groups), SENT)
    return written(sent.repartition("grp").sortWithinPartitions("grp").mapInArrow(_count, SENT), "repeated")


def _with(blocks: DataFrame, state: DataFrame, how: str) -> DataFrame:
    lists = state.groupBy("block").agg(F.collect_list(F.struct("piece", "grp", "bits")).alias("state"))
    return blocks.join(lists, "block", how)


def digests(docs: DataFrame, unit: str, span: int, key: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_units, n_removed, n_spans, kept_sha256."""
    found = find(docs, unit, span, key, doc_id, text)
    columns = ["doc_id", "n_units", "n_removed", "n_spans", "kept_sha256"]
    if not key:
        return found.select(*columns)
    # repeated rows lose the same
    cut = found.select("k1", "k2", "n_removed", "n_spans", F.col("kept_sha256").alias("cut_sha256")).dropDuplicates(["k1", "k2"])
    data = F.coalesce("text", F.lit("")).cast("binary")
    own = _keyed(docs, span, doc_id, text).select("k1", "k2", "doc_id", F.octet_length(data).cast("long").alias("n_units"), F.sha2(data, 256).alias("kept_sha256"))
    zero = F.lit(0).cast("long")
    return own.join(cut, ["k1", "k2"], "left").select(
        "doc_id", "n_units", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("cut_sha256", "kept_sha256").alias("kept_sha256")
    )


def remove(docs: DataFrame, unit: str, span: int, key: int | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all columns, with repeated spans cut out of their text; what has none is unchanged."""
    lost = find(docs, unit, span, key, doc_id, text).filter("n_removed > 0").select("k1", "k2", "kept").dropDuplicates(["k1", "k2"])
    rows = wrap(docs, k1=F.xxhash64(doc_id, text), k2=F.xxhash64(text, F.lit(span)), text=F.col(text)).join(lost, ["k1", "k2"], "left")
    return unwrap(rows, **{text: F.coalesce("kept", "text")})
