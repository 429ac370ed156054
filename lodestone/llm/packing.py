"""Best-fit packing of whole corpora into sequences of a fixed capacity.

Lengths are whole numbers up to the capacity, so an instance is a histogram of at most `capacity`
counts however many documents there are. The histogram alone comes to the driver. There, dominance
reduction after Martello and Toth fixes item sets that provably dominate every other feasible set
for their largest item (a perfect pair; the only pair or triple that matters when no more items
can fit), each with as many copies as the counts allow, until nothing more can be proven. What is
left goes best fit, largest first, by whole groups of equal bins. Both write runs: which
consecutive items of a length go to which consecutive sequences. There are a few runs for each
length, so the table of runs is bounded by the capacity and is what executors receive.

Items of a length are numbered without any global sort: a task counts them as it makes them, and
the tasks' counts, one row for each task and length, are summed up before it.

Defined results: null text is empty; a document longer than the capacity is cut into full pieces
and a last one that may be shorter; with an end id no document is empty, without one an empty
document has no piece; repeated rows are packed each; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.tokens import Encoder, default_tokenizer
from lodestone.runtime import written

CAPACITY = 2048


class Runs:
    """(length, first item, items a bin, bins, first sequence, offset) of consecutive items."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        self.used = np.zeros_like(self.left)
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0

    def open(self, bins: int) -> int:
        at, self.sequences = self.sequences, self.sequences + bins
        return at

    def put(self, length: int, each: int, bins: int, sequence: int, offset: int) -> None:
        n = each * bins
        self.rows.append((length, int(self.used[length]), each, bins, sequence, offset))
        self.used[length] += n
        self.left[length] -= n

    def fix(self, lengths: list[int], bins: int) -> None:
        """bins new sequences that each hold these lengths."""
        sequence, offset = self.open(bins), 0
        for length in sorted(set(lengths), reverse=True):
            each = lengths.count(length)
            self.put(length, each, bins, sequence, offset)
            offset += each * length


def _best_pair(sizes: np.ndarray, left: np.ndarray, room: int) -> tuple[int, int, int]:
    """x >= y with the largest sum within room, and the largest y of any feasible pair; 0s if none."""
    best, most_y = (0, 0), 0
    i, j = 0, len(sizes) - 1  # sizes ascend
    while i <= j:
        y, x = int(sizes[i]), int(sizes[j])
        if x + y > room:
            j -= 1
            continue
        if i == j and left[x] < 2:
            break
        # a larger sum, or the same with the larger x
        if (x + y, x) > (sum(best), best[0]):
            best = (x, y)
        most_y = max(most_y, y)
        i += 1
    return (*best, most_y)


def _dominating(s: int, runs: Runs, capacity: int) -> list[int] | None:
    """A set with s, the largest left, that dominates all feasible sets with s; None if not proven.

    A set dominates another if the other's items can be shared out among its own, each share no
    larger than the item that takes it.
    """
    left = runs.left
    left[s] -= 1
    try:
        room = capacity - s
        sizes = np.flatnonzero(left[: room + 1])
        if not len(sizes):
            return [s]
        t = int(sizes[-1])
        if t == room:
            return [s, t]  # whatever else goes with s fits into t's place
        small: list[int] = []
        for v in sizes[:3]:
            small += [int(v)] * int(min(left[v], 3))
        small = small[:3]
        if len(small) < 2 or small[0] + small[1] > room:
            return [s, t]  # at most one more item: the largest
        x, y, most_y = _best_pair(sizes, left, room)
        if len(small) < 3 or sum(small) > room:  # at most two more items
            if t >= x + y:
                return [s, t]
            if x == t and y == most_y:
                return [s, x, y]
        return None
    finally:
        left[s] += 1


def reduce_instance(runs: Runs, capacity: int) -> None:
    """Fix dominating sets, largest item first, until a whole pass proves nothing more."""
    changed = True
    while changed:
        changed = False
        for s in np.flatnonzero(runs.left)[::-1]:
            s = int(s)
            while runs.left[s] > 0:
                found = _dominating(s, runs, capacity)
                if found is None:
                    break
                runs.fix(found, int(min(runs.left[v] // found.count(v) for v in set(found))))
                changed = True


def best_fit(runs: Runs, capacity: int) -> None:
    """Best fit of what is left, largest first; equal bins are handled together."""
    open_bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room: (first sequence, bins)
    has = np.zeros(capacity + 1, dtype=bool)

    def keep(room: int, sequence: int, bins: int) -> None:
        if bins:
            open_bins[room].append((sequence, bins))
            has[room] = True

    for s in np.flatnonzero(runs.left)[::-1]:
        s = int(s)
        while (n := int(runs.left[s])) > 0:
            rooms = np.flatnonzero(has[s:])
            if len(rooms):
                room = s + int(rooms[0])
                sequence, bins = open_bins[room].pop()
                has[room] = bool(open_bins[room])
            else:
                room, bins = capacity, -(-n // (capacity // s))
                sequence = runs.open(bins)
            each = room // s
            full = min(bins, n // each)
            if full:
                runs.put(s, each, full, sequence, capacity - room)
                keep(room - each * s, sequence, full)
            rest = min(int(runs.left[s]), each - 1) if full < bins else 0
            if rest:
                runs.put(s, rest, 1, sequence + full, capacity - room)
                keep(room - rest * s, sequence + full, 1)
            keep(room, sequence + full + bool(rest), bins - full - bool(rest))


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Runs for a histogram (counts[length], length 0..capacity), by length and first item."""
    runs = Runs(counts)
    runs.left[0] = 0
    reduce_instance(runs, capacity)
    best_fit(runs, capacity)
    return np.array(sorted(runs.rows), dtype=np.int64).reshape(-1, 6)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, slice int, nth long"


def _cut(path: str, capacity: int, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = Encoder.of(path), TaskContext.get().partitionId()
        tail = b"" if end_id is None else struct.pack("<I", end_id)
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            cols: tuple[list, ...] = tuple([] for _ in range(7))
            for doc, data in zip(b.column(0).to_pylist(), enc.each(b.column(1))):
                data += tail
                n = len(data) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    row = (doc, piece, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), part, int(seen[length]))
                    seen[length] += 1
                    for c, v in zip(cols, row):
                        c.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "slice", "nth"]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types)], names=names)

    return run


def _place(runs: np.ndarray, capacity: int):
    first = np.searchsorted(runs[:, 0], np.arange(capacity + 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one sorted key over (length, first item): a run is found by one search
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            nth = b.column("nth").to_numpy(zero_copy_only=False)
            at = np.empty(len(length), dtype=np.int64)
            for v in np.unique(length):
                mine = np.flatnonzero(length == v)
                lo, hi = first[v], first[v + 1]
                at[mine] = lo + np.searchsorted(runs[lo:hi, 1], nth[mine], side="right") - 1
            r = runs[at] if len(at) else runs[:0]
            i = nth - r[:, 1]
            sequence = r[:, 4] + i // r[:, 2]
            offset = r[:, 5] + i % r[:, 2] * length
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int | None = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: its document, place there, checksum of its ids, sequence and offset in it."""
    path = tokenizer or default_tokenizer()
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = written(texts.mapInArrow(_cut(path, capacity, end_id), PIECES), "pieces")
    sizes = pieces.groupBy("slice", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("slice")) - F.col("n")
    bases = sizes.select("slice", "length", before.alias("base"))
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most `capacity` rows
        counts[r["length"]] = r["n"]
    runs = plan(counts, capacity)
    numbered = pieces.join(bases, ["slice", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("nth")
    )
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered.mapInArrow(_place(runs, capacity), out)
