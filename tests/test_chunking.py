from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.operators.chunking import Chunker, build_chunks, windows
from pyspark.sql import functions as F


def test_small_document_is_one_piece():
    assert Chunker().pieces("# A\n\ntext") == ["# A\n\ntext"]
    assert Chunker().pieces(" \n ") == [""]


def test_levels_never_share_a_piece():
    body = "x" * 220
    assert Chunker(1500, 0).pieces(f"# A\n{body}\n## B\n{body}\n## C\n{body}") == [f"# A\n{body}", f"## B\n{body}\n\n## C\n{body}"]


def test_overlap_crosses_size_breaks_only():
    a, b = "## A\n" + "a" * 250, "## B\n" + "b" * 250
    got = Chunker(400, 20).pieces(f"{a}\n{b}")
    assert got == [a, "a" * 20 + "\n\n" + b]


def test_oversized_section_repeats_its_heading():
    paras = "\n\n".join(c * 250 for c in "abc")
    got = Chunker(300, 0).pieces(f"## Head\n\n{paras}")
    assert got[0].startswith("## Head") and all(p.startswith("## Head") for p in got)
    assert all(len(p) <= 300 for p in got)


def test_tiny_pieces_merge_forward_then_back():
    c = Chunker(300, 0)
    assert c._merge(["a" * 10, "b" * 250]) == ["a" * 10 + "\n\n" + "b" * 250]
    assert c._merge(["b" * 250, "a" * 10]) == ["b" * 250 + "\n\n" + "a" * 10]
    assert c._merge(["b" * 295, "a" * 10, "c" * 295]) == ["b" * 295, "a" * 10, "c" * 295]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["# H\n", "## K\n", "word " * 30, "long" * 200, "\n\n", "x"]), max_size=20), st.integers(20, 400), st.integers(0, 60))
def test_no_word_is_lost(parts, size, overlap):
    text = "".join(parts)
    pieces = Chunker(size, overlap).pieces(text)
    assert pieces
    if text.strip():
        joined = "".join("".join(pieces).split())
        for word in {p.strip() for p in parts if p.strip() and len(p.strip()) <= 5}:
            assert word.split()[0] in joined


def test_windows_match_their_definition(spark):
    text = "".join(chr(97 + i % 26) for i in range(1000))
    for size, overlap in ((100, 20), (100, 0), (100, 100), (1000, 10), (999, 10)):
        step = size - overlap if 0 < overlap < size else size
        want = [text] if len(text) <= size else [text[i : i + size] for i in range(0, len(text), step)]
        assert spark.createDataFrame([(text,)], "t string").select(windows(F.col("t"), size, overlap)).first()[0] == want


def test_front_matter_only_document_keeps_its_card(spark):
    row = [("c", "a.md", "T", "", ".md", 1.0, "", "About it", "Other", None, None)]
    docs = spark.createDataFrame(row, "collection string, path string, title string, folder string, extension string, mtime double, content string, summary string, aliases string, status string, as_of string")
    got = build_chunks(docs).collect()
    assert len(got) == 1 and got[0].text == "Document: T\nFolder: \n\nAlso known as: Other\nSummary: About it"
