"""Token ids of whole texts, and a directly addressable file format for them.

Encoder gives exactly the ids of tokenizers' own encode(): the vocabulary used here drops white space
and cuts text into units (runs of letters, single digits, runs of other marks) that it encodes one by
one. Units are found and looked up as arrays, many texts at a time, in a bounded table keyed by 128
bits of hash; only units that the table lacks are encoded, in one call. Texts beyond Latin-1 go by
white-space separated words, and texts with special characters are encoded whole.

The format is a directly addressable code. Ids are cut into 8-bit chunks, lowest first. Level l
holds chunk l of the ids that have one, a bitmap saying which of them go on to level l + 1, and a
rank directory with the number of set bits before every 512th bit. Id i is read by its chunk at
level 0 and, while its bit is set, by the chunk at position rank(bit) of the next level; no block is
decoded. A segment holds consecutive documents and their start offsets.

Segments lie uncompressed in files, one a writer task, so any of their bytes can be read by itself: read_token()
fetches some hundred bytes of one. Which file a segment is in, where, and what documents it has says the
directory, a small Parquet table; it is written by Spark's committer, and files that it does not name
(of failed or repeated tasks) do not count. Paths are of any store that pyarrow.fs knows.

Defined results: null text is empty, so a document is its end id alone; documents come by ascending doc_id, null
first, ties by a hash of the text; repeated rows come out each; an empty table gives an empty directory; a very
long text is a segment of its own, encoded some PIECE_CHARS at a time; columns other than the id and the
text are not read.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodestone.runtime import ship

SEGMENT_TOKENS = 1 << 18
READ_BYTES = 1 << 24
TABLE_BITS = 20
CACHE_WORDS = 100_000
PIECE_CHARS = 1 << 18
GROUP_CHARS = 1 << 18
# Python splits at the first four, the tokenizer does not; the last starts a special token
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
_SPACE = re.compile(r"[ \n\r\t]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class UnitTable:
    """Ids of units by two 64-bit hashes, in arrays with open addressing; emptied when half full."""

    def __init__(self, bits: int = TABLE_BITS):
        self.size = 1 << bits
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros((2, self.size), np.uint64)
        self.first = np.zeros(self.size, np.int64)
        self.count = np.zeros(self.size, np.int32)
        self.ids = np.zeros(1 << 16, "<u4")
        self.used = self.filled = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys (two rows); -1 for what is not there."""
        out = np.full(keys.shape[1], -1, np.int64)
        at = (keys[0] & np.uint64(self.size - 1)).astype(np.int64)
        todo = np.arange(keys.shape[1])
        while len(todo):
            here = self.keys[0][at]
            same = (here == keys[0][todo]) & (self.keys[1][at] == keys[1][todo])
            out[todo[same]] = at[same]
            on = ~same & (here != 0)
            todo, at = todo[on], (at[on] + 1) & (self.size - 1)
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """New keys, each once, with their ids one after the other."""
        if 2 * (self.used + keys.shape[1]) > self.size:
            raise OverflowError
        if self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.filled], np.zeros(max(len(ids), len(self.ids)), "<u4")])
        self.ids[self.filled : self.filled + len(ids)] = ids
        first = self.filled + np.cumsum(counts) - counts
        self.filled += len(ids)
        self.used += keys.shape[1]
        at = (keys[0] & np.uint64(self.size - 1)).astype(np.int64)
        todo = np.arange(keys.shape[1])
        while len(todo):
            free = np.flatnonzero(self.keys[0][at] == 0)
            slot, which = np.unique(at[free], return_index=True)
            own = todo[free[which]]
            self.keys[:, slot] = keys[:, own]
            self.first[slot], self.count[slot] = first[own], counts[own]
            placed = np.zeros(len(todo), bool)
            placed[free[which]] = True
            todo, at = todo[~placed], (at[~placed] + 1) & (self.size - 1)

    def room(self, n: int) -> bool:
        """Whether n more fit; if not, the table is empty afterwards."""
        if 2 * (self.used + n) <= self.size:
            return True
        self._clear()
        return False


def _classes() -> np.ndarray:
    """0 space, 1 letter, 2 digit, 3 other, for the characters of Latin-1 in lower case."""
    out = np.full(256, 3, np.uint8)
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = 0
    out[[*range(97, 123), 0xAA, 0xB5, 0xBA, *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = 1
    out[[*range(48, 58), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = 2
    return out


_CLASS = _classes()
_RNG = np.random.default_rng(7)
_CODES = _RNG.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of base k and of its inverse, modulo 2 ** 64."""
    if k not in _POWERS or len(_POWERS[k][0]) < n:
        pair = []
        for base in (_BASES[k], pow(_BASES[k], -1, 1 << 64)):
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        _POWERS[k] = tuple(pair)
    return _POWERS[k]


def units(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokenizer's units in lower-case Latin-1 text: runs of letters, single
    digits, runs of other marks, and the endings 's 't 're 've 'm 'll 'd where the mark starts its run."""
    kind = _CLASS[data]
    before = np.concatenate([[np.uint8(0)], kind[:-1]])
    start = (kind != 0) & ((kind != before) | (kind == 2))
    marks = np.flatnonzero((data == 39) & start)
    if len(marks):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        a, b = padded[marks + 1], padded[marks + 2]
        two = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        three = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))
        start[marks[two | three] + 1] = False
        for ends in (marks[two] + 2, marks[three] + 3):
            ends = ends[ends < len(data)]
            start[ends[kind[ends] == 1]] = True
    starts = np.flatnonzero(start)
    after = np.concatenate([kind[1:] == 0, [True]]) | np.concatenate([start[1:], [True]])
    return starts, np.flatnonzero(after & (kind != 0)) + 1


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes."""

    _made: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.table = UnitTable()
        self.words: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """One per worker process, kept between its tasks."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _plain(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _of_units(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that are one unit each, one after the other, and how many each has."""
        got = self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids
        ids = np.asarray(got, dtype="<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1  # the last token of a unit says so
        if len(ends) != len(parts):
            each = [np.asarray(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
            return np.concatenate(each), np.array([len(x) for x in each], np.int32)
        return ids, np.diff(ends, prepend=0).astype(np.int32)

    def _latin(self, texts: list[bytes]) -> list[bytes]:
        """Lower-case Latin-1 texts."""
        joined = b"\n".join(texts)
        data = np.frombuffer(joined, np.uint8)
        starts, ends = units(data)
        if not len(starts):
            return [b""] * len(texts)
        with np.errstate(over="ignore"):
            keys = np.empty((2, len(starts)), np.uint64)
            for k in (0, 1):
                power, back = _powers(k, len(data) + 1)
                sums = np.empty(len(data) + 1, np.uint64)
                sums[0] = 0
                np.cumsum(_CODES[k][data] * power[: len(data)], out=sums[1:])
                h = (sums[ends] - sums[starts]) * back[starts]
                h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                keys[k] = (h ^ (h >> np.uint64(32))) | np.uint64(1)
        slots = self.table.find(keys)
        new = np.flatnonzero(slots < 0)
        if len(new):
            once = new[np.unique(keys[0][new], return_index=True)[1]]
            if not self.table.room(len(once)):
                once = np.unique(keys[0], return_index=True)[1]
                new = np.arange(len(starts))
            parts = [joined[a:b].decode("latin-1") for a, b in zip(starts[once].tolist(), ends[once].tolist())]
            self.table.add(keys[:, once], *self._of_units(parts))
            slots[new] = self.table.find(keys[:, new])
        counts = self.table.count[slots]
        upto = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        source = np.repeat(self.table.first[slots] - upto[:-1], counts) + np.arange(upto[-1])
        ids = self.table.ids[source].tobytes()
        borders = np.cumsum([0] + [len(t) + 1 for t in texts])
        at = (4 * upto[np.searchsorted(starts, borders)]).tolist()
        return [ids[a:b] for a, b in zip(at, at[1:])]

    def _wide(self, text: str) -> bytes:
        """Text beyond Latin-1, by its white-space separated words."""
        words = text.split()
        new = [w for w in set(words) if w not in self.words]
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words.clear()
            new = list(set(words))
        for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            self.words[w] = np.asarray(e.ids, dtype="<u4").tobytes()
        return b"".join(map(self.words.__getitem__, words))

    def _pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of several texts; what is new in them is encoded in one call."""
        out: list[bytes] = [b""] * len(texts)
        latin: list[tuple[int, bytes]] = []
        for k, t in enumerate(texts):
            if any(c in t for c in _ODD):
                out[k] = self._plain(t)
                continue
            try:
                latin.append((k, t.lower().encode("latin-1")))
            except UnicodeEncodeError:
                out[k] = self._wide(t)
        if latin:
            for (k, _), ids in zip(latin, self._latin([t for _, t in latin])):
                out[k] = ids
        return out

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        group: list[str] = []
        size = 0

        def flush() -> None:
            nonlocal size
            out.extend(self._pieces(group))
            group.clear()
            size = 0

        for text in texts:
            if text and len(text) > PIECE_CHARS:
                flush()
                out.append(self._long(text))
                continue
            group.append(text or "")
            size += len(group[-1])
            if size > GROUP_CHARS:
                flush()
        flush()
        return out

    def each(self, column) -> Iterator[bytes]:
        """Ids of an Arrow column of texts, some rows at a time."""
        for at in range(0, len(column), 256):
            yield from self.encode_many(column.slice(at, 256).to_pylist())

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def _long(self, text: str) -> bytes:
        parts, at = [], 0
        while at < len(text):
            cut = _SPACE.search(text, at + PIECE_CHARS)
            end = cut.end() if cut else len(text)
            parts += self._pieces([text[at:end]])
            at = end
        return b"".join(parts)


MAGIC, VERSION = b"LDAC", 2
RANK_BITS = 512


def _level(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks, continuation bits, rank directory, and what goes on to the next level."""
    more = values > 0xFF
    bits = np.packbits(more, bitorder="little")
    padded = np.zeros(-(-len(more) // RANK_BITS) * RANK_BITS, dtype=bool)
    padded[: len(more)] = more
    per = padded.reshape(-1, RANK_BITS).sum(axis=1, dtype=np.uint32)
    ranks = np.concatenate([[0], np.cumsum(per)]).astype("<u4")
    return (values & 0xFF).astype(np.uint8), bits, ranks, values[more] >> 8


def pack_segment(lengths: list[int], ids: np.ndarray) -> bytes:
    """ids (unsigned 32-bit) of documents with these lengths, as one self-contained segment."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        chunks, bits, ranks, rest = _level(rest)
        levels.append((chunks, bits, ranks))
        if not len(rest):
            break
    out = [MAGIC, struct.pack("<III", VERSION, len(lengths), len(levels))]
    out.append(struct.pack(f"<{len(levels)}Q", *(len(chunks) for chunks, _, _ in levels)))
    out.append(np.concatenate([[0], np.cumsum(np.asarray(lengths, dtype=np.int64))]).astype("<i8").tobytes())
    for chunks, bits, ranks in levels:
        out += [chunks.tobytes(), bits.tobytes(), ranks.tobytes()]
    return b"".join(out)


class Segment:
    """Random access to a packed segment, by fetch(offset, size) or from its bytes."""

    def __init__(self, source: bytes | Callable[[int, int], bytes]):
        self._fetch = source if callable(source) else lambda at, n, data=memoryview(source): data[at : at + n]
        magic, version, self.n_docs, n_levels = struct.unpack("<4sIII", self._fetch(0, 16))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token segment")
        sizes = struct.unpack(f"<{n_levels}Q", self._fetch(16, 8 * n_levels))
        self._starts = at = 16 + 8 * n_levels
        at += 8 * (self.n_docs + 1)
        self._levels = []  # where chunks, bits and ranks begin
        for n in sizes:
            self._levels.append((at, at + n, at + n + -(-n // 8)))
            at += n + -(-n // 8) + 4 * (-(-n // RANK_BITS) + 1)

    def _array(self, at: int, kind: str, first: int, end: int) -> np.ndarray:
        """Items first..end of an array that begins at a place."""
        size = np.dtype(kind).itemsize
        return np.frombuffer(self._fetch(at + size * first, size * (end - first)), kind)

    def starts(self, first: int, end: int) -> np.ndarray:
        """How many ids of the segment stand before documents first..end."""
        return self._array(self._starts, "<i8", first, end)

    def _rank(self, bits: int, ranks: int, i: int) -> int:
        """Set bits before the i-th."""
        block = i // RANK_BITS
        first = block * RANK_BITS // 8
        left = np.unpackbits(self._array(bits, "u1", first, -(-i // 8)), bitorder="little")[: i - block * RANK_BITS]
        return int(self._array(ranks, "<u4", block, block + 1)[0]) + int(left.sum())

    def token(self, i: int) -> int:
        value, shift = 0, 0
        for chunks, bits, ranks in self._levels:
            value |= int(self._array(chunks, "u1", i, i + 1)[0]) << shift
            if not self._array(bits, "u1", i // 8, i // 8 + 1)[0] >> (i % 8) & 1:
                break
            i, shift = self._rank(bits, ranks, i), shift + 8
        return value

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Ids start..end: at every level the chunks of a range are a range."""
        out = np.zeros(end - start, dtype=np.uint32)
        where, shift = np.arange(end - start), 0
        for chunks, bits, ranks in self._levels:
            if end <= start:
                break
            out[where] |= self._array(chunks, "u1", start, end).astype(np.uint32) << np.uint32(shift)
            on = np.unpackbits(self._array(bits, "u1", start // 8, -(-end // 8)), bitorder="little")[start % 8 : start % 8 + end - start].astype(bool)
            where = where[on]
            start = self._rank(bits, ranks, start) if len(where) else 0
            end, shift = start + len(where), shift + 8
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(*self.starts(k, k + 2).tolist())


DIRECTORY = "part int, seq int, file string, at long, size long, n_docs long, n_tokens long, low long, high long, doc_ids array<long>"


def store(uri: str) -> tuple[FileSystem, str]:
    """The file system of a path, and the path there."""
    return FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if not uri.startswith("file:") else "file://" + uri.removeprefix("file:"))


def _writer(path: str, end_id: int, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = Encoder.of(path), TaskContext.get().partitionId()
        tail = struct.pack("<I", end_id)
        fs, base = store(out)
        name = f"part-{part:05d}-{uuid.uuid4().hex}.tokens"
        file, rows = None, []
        docs, parts, size = [], [], 0

        def flush():
            nonlocal file, docs, parts, size
            if file is None:
                fs.create_dir(f"{base}/segments", recursive=True)
                file = fs.open_output_stream(f"{base}/segments/{name}", compression=None)
            ids = np.frombuffer(b"".join(parts), dtype="<u4")
            packed = pack_segment([len(x) // 4 for x in parts], ids)
            known = [d for d in docs if d is not None]
            rows.append((part, len(rows), name, file.tell(), len(packed), len(docs), len(ids), min(known, default=None), max(known, default=None), docs))
            file.write(packed)
            docs, parts, size = [], [], 0

        for b in batches:
            for doc, data in zip(b.column(0).to_pylist(), enc.each(b.column(1))):
                data += tail
                if docs and size + len(data) // 4 > SEGMENT_TOKENS:
                    flush()
                docs.append(doc)
                parts.append(data)
                size += len(data) // 4
        if docs:
            flush()
        if file is not None:
            file.close()  # rows go out once the file is whole
            i64 = pa.int64()
            types = [pa.int32(), pa.int32(), pa.string(), i64, i64, i64, i64, i64, i64, pa.list_(i64)]
            names = [x.split()[0] for x in DIRECTORY.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def write_tokens(docs: DataFrame, out: str, tokenizer: str | None = None, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of every document, ascending doc_id (null first, ties by text), as segments at out."""
    path = tokenizer or default_tokenizer()
    ship(docs.sparkSession)
    ordered = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        .repartitionByRange(F.col("doc_id"), F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    ordered.mapInArrow(_writer(path, end_id, out), DIRECTORY).write.parquet(f"{out}/directory")


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """Segments with first, the number of ids before each in the whole file order."""
    seg = spark.read.schema(DIRECTORY).parquet(f"{path}/directory")
    sizes = seg.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row a part: as many as the writer had tasks
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    firsts = sizes.withColumn("in_part", within).join(before, "part").select("part", "seq", (F.col("base") + F.col("in_part")).alias("first"))
    return seg.join(firsts, ["part", "seq"])


def _fetcher(file, at: int) -> Callable[[int, int], bytes]:
    """Ranged reads of a segment that begins at a place in a file."""

    def fetch(offset: int, size: int) -> bytes:
        file.seek(at + offset)
        return file.read(size)

    return fetch


def read_token(path: str, doc_id: int, i: int) -> int:
    """Id i of the first document with this id: a directory entry, then ranged reads of a few bytes each."""
    fs, base = store(path)
    near = (pads.field("low") <= doc_id) & (pads.field("high") >= doc_id)
    entries = pads.dataset(f"{base}/directory", filesystem=fs, format="parquet").to_table(columns=["part", "seq", "file", "at", "doc_ids"], filter=near)
    order = sorted(range(entries.num_rows), key=lambda k: (entries["part"][k].as_py(), entries["seq"][k].as_py()))
    for k in order:
        ids = entries["doc_ids"][k].as_py()
        if doc_id in ids:
            with fs.open_input_file(f"{base}/segments/{entries['file'][k].as_py()}") as file:
                seg = Segment(_fetcher(file, entries["at"][k].as_py()))
                first, end = seg.starts(ids.index(doc_id), ids.index(doc_id) + 2).tolist()
                if not 0 <= i < end - first:
                    raise IndexError(f"document {doc_id} has {end - first} ids")
                return seg.token(first + i)
    raise KeyError(doc_id)


def _reader(out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(out)
        for b in batches:
            for first, name, at, size, ids in zip(*(c.to_pylist() for c in b.columns)):
                with fs.open_input_file(f"{base}/segments/{name}") as file:
                    seg = Segment(_fetcher(file, at)(0, size))
                starts = seg.starts(0, seg.n_docs + 1).tolist()
                rows = []
                for doc, a, z in zip(ids, starts, starts[1:]):
                    got = seg.tokens(a, z)
                    rows.append((doc, first + a, z - a, zlib.crc32(got.astype("<u4").tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document as the files have it: place, length and checksum of its ids."""
    ship(spark)
    rows = read_directory(spark, path).select("first", "file", "at", "size", "doc_ids")
    # the rows are small, what they stand for is not: some segments a task
    tasks = max(1, rows.agg(F.ceil(F.sum("size") / READ_BYTES).alias("n")).first()["n"] or 1, spark.sparkContext.defaultParallelism)
    return rows.repartition(tasks, "file", "at").mapInArrow(_reader(path), "doc_id long, start long, n_tokens long, ids_crc32 long")
