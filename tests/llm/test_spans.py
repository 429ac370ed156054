"""Suffix-array and substring dedup against every window, one by one."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from lodestone.llm import repeats, substring_dedup, suffix_dedup
from nasty import nasty_rows


def brute(seqs, span):
    n = Counter(tuple(s[i : i + span]) if isinstance(s, list) else s[i : i + span] for s in seqs for i in range(len(s) - span + 1))
    for s in seqs:
        gone = np.zeros(len(s), dtype=bool)
        for i in range(len(s) - span + 1):
            if n[tuple(s[i : i + span]) if isinstance(s, list) else s[i : i + span]] > 1:
                gone[i : i + span] = True
        yield gone


def want(rows, unit, span):
    if unit == "bytes":
        seqs = [(t or "").encode() for _, t in rows]
    else:
        seqs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    out = []
    for (d, _), s, gone in zip(rows, seqs, brute(seqs, span)):
        kept = bytes(b for b, g in zip(s, gone) if not g) if unit == "bytes" else " ".join(w for w, g in zip(s, gone) if not g).encode()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()) if len(gone) else 0
        out.append((d, len(s), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(df, *args):
    return sorted((tuple(r) for r in repeats.digests(df, *args).collect()), key=repr)


def documents(seed, alphabet, joiner):
    """Random texts with copies, shared and shifted parts, and periodic runs."""
    r = random.Random(seed)
    make = lambda n: joiner.join(r.choice(alphabet) for _ in range(n))
    base = [make(r.choice([0, 5, 20, 60, 150])) for _ in range(25)]
    rows = base + [base[3], base[4][5:], base[7] + joiner + base[8], joiner.join([make(9)] * 8), joiner.join([make(3)] * 30), base[7][2:40] + joiner + make(30)]
    cut = base[9]
    rows += [cut[:k] + cut[k + 3 :] for k in (10, 30)] + [(alphabet[0] + joiner) * 70]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", range(3))
def test_bytes(spark, seed):
    rows = documents(seed, "ab" if seed == 0 else "abcdé", "")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, "bytes", 20, 4) == want(rows, "bytes", 20)


@pytest.mark.parametrize("seed", range(3))
def test_words(spark, seed):
    rows = documents(seed, ["a", "b"] if seed == 0 else ["x", "yy", "zzz", "É", "w"], " ")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df, "words", 9) == want(rows, "words", 9)


@pytest.mark.parametrize("unit", ["bytes", "words"])
def test_many_blocks_pieces_and_groups(spark, monkeypatch, unit):
    """Texts over many blocks, longer than pieces and chunks, with names in many groups."""
    for name, value in (("BLOCK", 100), ("PIECE", 64), ("CHUNK", 16), ("PER_GROUP", 8), ("LEAST_GROUPS", 4)):
        monkeypatch.setattr(repeats, name, value)
    rows = documents(7, "abcdé" if unit == "bytes" else ["x", "yy", "zzz", "É", "w"], "" if unit == "bytes" else " ")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    span, key = (20, 4) if unit == "bytes" else (9, None)
    # workers import the module anew, so the functions that run there are called here
    with np.errstate(over="ignore"):
        assert local(rows, unit, span, key) == want(rows, unit, span)
    monkeypatch.undo()
    assert got(df, unit, span, *([key] if key else [])) == want(rows, unit, span)


def local(rows, unit, span, key):
    """The rounds of repeats.find in this process."""
    import pyarrow as pa

    groups = 16
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.null()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*[(d, d, d, t, None) for d, t in rows]), types)], names=list("abcde"))

    class Task:
        @staticmethod
        def get():
            return Task

        partitionId = staticmethod(lambda: 0)

    repeats.TaskContext, kept = Task, repeats.TaskContext
    try:
        blocks = [b.to_pylist()[0] for b in repeats._packed(unit)(iter([batch]))]
    finally:
        repeats.TaskContext = kept
    assert len(blocks) > 3
    state, done = None, None
    kind = pa.list_(pa.struct([("piece", pa.int32()), ("grp", pa.int32()), ("bits", pa.binary())]))

    def batches(*fields):
        for b in blocks:
            mine = [s for s in state or () if s["block"] == b["block"]]
            yield pa.RecordBatch.from_arrays([pa.array([mine if f == "state" else b[f]], type=kind if f == "state" else None) for f in fields], names=list(fields))

    for now in repeats._rounds(unit, span, key):
        sent = pa.Table.from_batches(repeats._send(unit, span, done, now, groups)(batches("block", "text", "open", "state"))).sort_by("grp")
        state = [r for b in repeats._count(iter(sent.combine_chunks().to_batches())) for r in b.to_pylist()]
        done = now
    out = [r for b in repeats._cut(unit, span, done, groups)(batches("text", "state", "k1", "k2", "doc_id")) for r in b.to_pylist()]
    return sorted(((r["doc_id"], r["n_units"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out), key=repr)


def test_anchors_of_pieces(monkeypatch):
    r = random.Random(5)
    text = "".join(r.choice("abc") for _ in range(3000))
    with np.errstate(over="ignore"):
        lo, hi, gram = repeats.anchors(repeats.Bytes([text]), 20, 4)
        assert lo[0] == 0 and hi[-1] == 2980 and (lo[1:] == hi[:-1] + 1).all()
        monkeypatch.setattr(repeats, "PIECE", 64)
        cut = {s: g for a, z, g in zip(*repeats.anchors(repeats.Bytes([text]), 20, 4)) for s in range(a, z + 1)}
    assert cut == {s: g for a, z, g in zip(lo, hi, gram) for s in range(a, z + 1)}


def test_names_survive_the_way():
    r = np.random.default_rng(2)
    for n, top in ((1, 56), (2, 8), (500, 56), (500, 30), (3, 12)):
        x = np.unique(r.integers(0, 1 << top, n, dtype=np.uint64))
        steps = np.diff(x, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
        used = next((w for w in range(8, 0, -1) if steps[1:, w - 1].any()), 1)
        assert (repeats._names(steps[0].tobytes() + bytes([used]) + steps[1:, :used].tobytes()) == x).all()


def test_odd_rows_with_production_parameters(spark, nasty, nothing):
    rows = nasty_rows()
    found = sorted((tuple(r) for r in suffix_dedup.find(nasty).collect()), key=repr)
    assert found == want(rows, "bytes", 400) and any(r[2] for r in found)
    words = sorted(((r.doc_id, r.n_words, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.find(nasty).collect()), key=repr)
    assert words == want(rows, "words", 35) and any(r[2] for r in words)
    left = substring_dedup.remove(nasty)
    assert left.columns == nasty.columns and left.count() == len(rows)
    assert suffix_dedup.remove(nasty).count() == len(rows)
    assert suffix_dedup.find(nothing).count() == 0 and substring_dedup.remove(nothing).count() == 0


@pytest.mark.parametrize("unit", ["bytes", "words"])
def test_row_groups_hold_few_blocks(spark, unit):
    """A task that makes many blocks writes them in row groups of a bounded size: it holds one at a time, and so does a reader."""
    r = random.Random(3)
    text = "".join(r.choices("abcdefgh ", k=1 << 20))
    rows = [(i, i, i, text[i:] + text[:i]) for i in range(24)]
    df = spark.createDataFrame(rows, "k1 long, k2 long, doc_id long, text string").coalesce(1)
    df = df.selectExpr("*", "cast(null as array<struct<lo:bigint,hi:bigint>>) as ranges")
    blocks = repeats._blocks(df, unit)
    (name,) = blocks.inputFiles()
    meta = pq.ParquetFile(name.removeprefix("file://")).metadata
    assert meta.num_rows >= 12
    groups = [meta.row_group(i) for i in range(meta.num_row_groups)]
    assert max(g.num_rows for g in groups) <= 2 and max(g.total_byte_size for g in groups) < 3 * repeats.BLOCK
    assert sorted(d for b in blocks.collect() for d in b.doc_id) == list(range(24))


def test_key_is_checked(nothing):
    for key in (None, 3, 32):
        with pytest.raises(ValueError):
            repeats.find(nothing, "bytes", 20, key)
