"""Token files and packing."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import packing, tokens
from nasty import nasty_rows


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder.of(tokens.default_tokenizer())


ALPHABET = list("abcXYZ ÀÉßéüñ'’“.,!?0 12²½\n\t_-|<>\xa0\x85µªÿ÷×İσΣς한글日é\x1c\x0b") + ["'s", "'ll", "<|endoftext|>", "<|", "it's", "DON'T", "ﬁ", "Ⅳ"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=30).map("".join))
def test_ids_are_the_tokenizers_own(text):
    e = tokens.Encoder.of(tokens.default_tokenizer())
    want = e.tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(e.encode(text), "<u4").tolist() == want


def test_many_texts_and_a_small_table(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 20)
    monkeypatch.setattr(tokens, "PIECE_CHARS", 50)
    monkeypatch.setattr(tokens, "GROUP_CHARS", 400)
    r = random.Random(2)
    latin = [c for c in ALPHABET if all(ord(x) < 256 for x in c) and c not in ("\x1c", "<|", "<|endoftext|>")]
    texts = ["".join(r.choice(r.choice([ALPHABET, latin, latin])) for _ in range(r.randint(0, 300))) for _ in range(200)] + [None, ""]
    e = tokens.Encoder(tokens.default_tokenizer())
    e.table = tokens.UnitTable(10)  # emptied many times
    assert e.encode_many(texts) == [e._plain(t or "") for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700), min_size=1, max_size=6))
def test_segments_give_random_access(docs):
    flat = np.array([x for d in docs for x in d], dtype=np.uint32)
    seg = tokens.Segment(tokens.pack_segment([len(d) for d in docs], flat))
    for k, d in enumerate(docs):
        assert seg.document(k).tolist() == d
    for i in range(0, len(flat), 37):
        assert seg.token(i) == flat[i]
    if len(flat) > 3:
        assert seg.tokens(1, len(flat) - 1).tolist() == flat[1:-1].tolist()


def test_files_round_trip(spark, encoder, nasty, nothing, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "SEGMENT_TOKENS", 100)
    tokens.write_tokens(nasty, f"file://{tmp_path}/t")
    got = sorted(tuple(r) for r in tokens.read_documents(spark, f"file://{tmp_path}/t").filter("doc_id is not null").collect())
    rows, at = sorted(((d is not None, d or 0), t) for d, t in nasty_rows() if d is not None and d != 4), 0
    ids = {d: np.asarray(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4") for (_, d), t in rows}
    by = {r[0]: r for r in got}
    for d, v in ids.items():
        assert by[d][2:] == (len(v), zlib.crc32(v.tobytes()))
    starts = sorted((r[1], r[2]) for r in tokens.read_documents(spark, f"file://{tmp_path}/t").select("doc_id", "start", "n_tokens").collect())
    for s, n in starts:
        assert s == at
        at += n
    assert len(starts) == len(nasty_rows()) and [r[0] for r in sorted(got, key=lambda r: r[1])] == sorted(r[0] for r in got)
    tokens.write_tokens(nothing, f"file://{tmp_path}/none")
    assert tokens.read_documents(spark, f"file://{tmp_path}/none").count() == 0


def test_one_token_takes_a_few_bytes(spark, encoder, tmp_path, monkeypatch):
    texts = [(k, " ".join(f"word{(k * 7 + j) % 911} house" for j in range(400 * (k % 5)))) for k in range(60)]
    out = f"file://{tmp_path}/t"
    tokens.write_tokens(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), out)
    size = sum(r["size"] for r in tokens.read_directory(spark, out).collect())
    fetched = []
    plain = tokens._fetcher

    def counting(file, at):
        fetch = plain(file, at)
        return lambda offset, n: fetched.append(n) or fetch(offset, n)

    monkeypatch.setattr(tokens, "_fetcher", counting)
    for k, j in ((0, 0), (4, 0), (4, 1500), (59, 77), (33, 801)):
        ids = encoder.tokenizer.encode(texts[k][1], add_special_tokens=False).ids + [1]
        fetched.clear()
        assert tokens.read_token(out, k, j) == ids[j]
        assert sum(fetched) <= 400 < size / 100
    with pytest.raises(IndexError):
        tokens.read_token(out, 0, 1)
    with pytest.raises(KeyError):
        tokens.read_token(out, 99, 0)


def unpack(counts, capacity):
    runs = packing.plan(counts, capacity)
    bins, used = {}, np.zeros_like(counts)
    for length, first, each, n, sequence, offset in runs:
        assert first == used[length]
        used[length] += each * n
        for k in range(n):
            bins.setdefault(sequence + k, []).extend((offset + j * length, length) for j in range(each))
    want = counts.copy()
    want[0] = 0
    assert (used == want).all() and sorted(bins) == list(range(len(bins)))
    for items in bins.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= capacity
    return len(bins)


def fewest(lengths, capacity):
    """Exact, for small sets: branch over the bin of each item."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        seen = set()
        for k, free in enumerate(bins):
            if free >= lengths[i] and free not in seen:
                seen.add(free)
                place(i + 1, bins[:k] + [free - lengths[i]] + bins[k + 1 :])
        place(i + 1, [*bins, capacity - lengths[i]])

    place(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.integers(6, 30).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=9))))
def test_packing_is_valid_and_the_reduction_safe(case):
    capacity, lengths = case
    counts = np.bincount(lengths, minlength=capacity + 1)
    n = unpack(counts, capacity)
    best = fewest(lengths, capacity)
    assert best <= n <= best + 1
    runs = packing.Runs(counts)
    packing.reduce_instance(runs, capacity)
    rest = [v for v, k in enumerate(runs.left) for _ in range(k)]
    assert runs.sequences + fewest(rest, capacity) == best  # what was fixed costs nothing


def test_large_histograms_give_few_runs():
    lengths = np.clip(np.random.default_rng(0).lognormal(5.5, 1, 20000).astype(int), 1, 2048)
    counts = np.bincount(lengths, minlength=2049)
    assert unpack(counts, 2048) <= -(-int((np.arange(2049) * counts).sum()) // 2048) + 2
    assert len(packing.plan(counts * 1_000_000)) < 20_000


def test_pack_odd_rows(spark, encoder, nasty, nothing):
    rows = packing.pack(nasty, 64).collect()
    want = []
    for d, t in nasty_rows():
        ids = np.asarray(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want += [(d, k, s, len(ids[s : s + 64]), zlib.crc32(ids[s : s + 64].tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in rows)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 64
    assert packing.pack(nothing).count() == 0
