"""SimHash near-dedup and line dedup."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import graph, line_dedup, simhash
from nasty import nasty_rows, words

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(g.encode("utf-8", "surrogatepass"), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


@pytest.mark.parametrize("text", [t for _, t in nasty_rows()] + ["A B", "a  b\tc", "Ä ä"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=130), st.integers(0, 6))
def test_bit_sliced_distances(fps, radius):
    a = np.array(fps + [fps[0] ^ 0b1011, fps[-1] ^ (1 << 63)], dtype=np.uint64)
    sliced = simhash.planes(a)
    for q in a[:5].tolist():
        hits = simhash.near(q, sliced, len(a), radius)
        assert [hits >> k & 1 for k in range(len(a))] == [int(bin(q ^ v).count("1") <= radius) for v in a.tolist()]


def classes(fps, radius=3):
    up = list(range(len(fps)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("chunk", [1024, 3])
def test_links_span_all_components(spark, chunk):
    r = random.Random(chunk)
    fps = {r.getrandbits(64) for _ in range(30)}
    for f in list(fps)[:12]:
        for _ in range(8):
            f ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 3)))
            fps.add(f)
    fps = sorted(fps)
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(nodes, chunk=chunk).collect()]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in links)
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[find(a)] = find(b)
    want = classes(fps)
    mine = {}
    for f, c in zip(fps, want):
        assert mine.setdefault(c, find(f)) == find(f)
    assert len({find(f) for f in fps}) == len(set(want))


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(5000 + i, 5000 + (i + 1) % 9) for i in range(9)] + [(7, 7), (9000, 1030)]
    random.Random(1).shuffle(edges)
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in range(61)} == {found[0]} and found[9000] == found[1000] == found[1039]
    assert len(set(found.values())) == 3 and len(found) == 61 + 40 + 9 + 1


def test_simhash_of_odd_rows(spark, nasty, nothing):
    rows = nasty_rows()
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.cluster(nasty).collect()), key=repr)
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = classes(fps)
    ids = {c: min((d for (d, _), x in zip(rows, roots) if x == c and d is not None), default=None) for c in roots}
    assert got == sorted(((d, f"{f:016x}", ids[c]) for (d, _), f, c in zip(rows, fps, roots)), key=repr)
    left = simhash.deduplicate(nasty)
    assert left.columns == nasty.columns and left.count() == len(set(roots))
    assert simhash.cluster(nothing).count() == 0 and simhash.deduplicate(nothing).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def points(s):
    return np.frombuffer(s.encode("utf-32-le"), dtype="<u4")


@settings(max_examples=500, deadline=None)
@given(st.text("abé", max_size=9), st.text("abé", max_size=9), st.integers(0, 4))
def test_banded_distance(a, b, t):
    assert line_dedup.within(points(a), points(b), t) == (edits(a, b) <= t)


@settings(max_examples=500, deadline=None)
@given(st.text("abc", min_size=8, max_size=30), st.data(), st.integers(1, 4))
def test_lines_within_the_threshold_share_a_key(a, data, t):
    b = list(a)
    for _ in range(data.draw(st.integers(0, t))):
        k = data.draw(st.integers(0, len(b) - 1))
        b[k : k + data.draw(st.integers(0, 1))] = data.draw(st.sampled_from([[], ["a"], ["z"]]))
        if not b:
            b = ["a"]
    b = "".join(b)
    if len(b) > t:
        keys = [{(s, x[p : p + n]) for s, p, n in line_dedup.probes(len(x), t, t + 1)} for x in (a, b)]
        assert edits(a, b) > t or keys[0] & keys[1]


def plain_kept(rows, threshold=2, least=20):
    """rows in order of (id, null last): (id, text left, lines with a word, how many of them stay)."""
    has_word = lambda x: bool(re.search(r"[^\x20\x09-\x0D]", x))
    first, near = {}, set()
    for d, t in rows:
        for x in (t or "").split("\n"):
            if has_word(x) and x not in first:
                if len(x) >= least and any(len(y) >= least and abs(len(x) - len(y)) <= threshold and line_dedup.within(points(y), points(x), threshold) for y in first):
                    near.add(x)
                first[x] = True
    seen, out = set(), []
    for d, t in rows:
        kept, n, k = [], 0, 0
        for x in (t or "").split("\n"):
            if has_word(x):
                n += 1
                gone = x in seen or x in near
                seen.add(x)
                if gone:
                    continue
                k += 1
            kept.append(x)
        out.append((d, "\n".join(kept), n, k))
    return out


def plain_lines(rows):
    return sorted(((d, n, n - k, hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()) for d, t, n, k in plain_kept(rows)), key=repr)


@settings(max_examples=300, deadline=None)
@given(st.text("ab", min_size=5, max_size=24), st.lists(st.tuples(st.integers(0, 30), st.sampled_from(["a", "b", ""]), st.booleans()), max_size=3), st.integers(1, 3))
def test_matches_share_a_pair_of_segments(a, changes, t):
    b = a
    for at, c, insert in changes[:t]:
        b = b[:at] + c + b[at if insert else at + 1 :]
    if min(len(a), len(b)) > t and line_dedup.within(points(a), points(b), t):
        keys = [{(s, x[p : p + n], x[q : q + m]) for s, p, n, q, m in line_dedup.pairs_of_segments(len(x), t, t + 1)} for x in (a, b)]
        assert keys[0] & keys[1]


@pytest.mark.parametrize("chunk, hot", [(512, 4096), (2, 4096), (512, 2)])
def test_line_dedup(spark, monkeypatch, chunk, hot):
    monkeypatch.setattr(line_dedup, "CHUNK", chunk)
    monkeypatch.setattr(line_dedup, "HOT", hot)
    r = random.Random(chunk)
    base = [words(i, r.randint(1, 9), "abcde") for i in range(40)]
    rows = []
    for d in range(30):
        lines = []
        for _ in range(r.randint(0, 8)):
            x = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 2, 3])):
                x[r.randrange(len(x))] = r.choice("abcde ")
            lines.append("".join(x))
        rows.append((d, "\n".join(lines + [""])))
    got = sorted((tuple(x) for x in line_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=repr)
    assert got == plain_lines(rows)


def test_line_dedup_of_odd_rows(spark, nasty, nothing):
    rows = [x for x in nasty_rows() if x != (None, None)]
    order = sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0))  # repeated rows are one document
    want = plain_lines(order)
    got = sorted((tuple(x) for x in line_dedup.digests(nasty.filter("doc_id is not null or text is not null").dropDuplicates(["doc_id", "text"])).collect()), key=repr)
    assert got == want
    left = line_dedup.deduplicate(nasty)
    assert left.columns == nasty.columns and left.schema["n_chars"] == nasty.schema["n_chars"] and left.count() <= len(nasty_rows())
    assert {r.doc_id for r in left.collect()} >= {0, 1, 3, 4, 7}
    assert line_dedup.deduplicate(nothing).count() == 0
