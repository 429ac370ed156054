import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.functions import documents as D
from lodestone.functions import lexical as X
from lodestone.functions.porter2 import stem
from pyspark.sql import functions as F


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "word, want",
    [("consigned", "consign"), ("knackeries", "knackeri"), ("generously", "generous"), ("hopping", "hop"), ("hoping", "hope"), ("flies", "fli"), ("dies", "die"),
     ("relational", "relat"), ("skies", "sky"), ("news", "news"), ("proceed", "proceed"), ("embeddings", "embed"), ("communication", "communic"), ("by", "by"), ("say", "say"), ("cry", "cri")],
)
def test_stem(word, want):
    assert stem(word) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdefghijklmnopqrstuvwxyz'", max_size=14))
def test_stem_never_grows_or_fails(word):
    assert len(stem(word)) <= len(word) + 1


def test_rank_terms_keep_wholes_and_parts(spark):
    got = one(spark, "Foo-bars a/b snake_cases CLASS bus as", X.rank_terms)
    assert sorted(got) == sorted(["foo-bar", "foo", "bar", "a/b", "snake_case", "snake", "case", "clas", "bus", "as"])
    assert "how" not in one(spark, "how Hows whats", lambda c: X.rank_terms(c, True))


@pytest.mark.parametrize(
    "query, want",
    [("", False), ("what is bm25x of the", True), ("what are chunks", True), ("snake_case of the thing in question here", True), ("explain the API", True),
     ("explain the index of pages", False), ("index pages", True), ("a b c d e f g", False), ("one two three four five six seven", False), ("say it 3 times to the man", True)],
)
def test_keywordish(spark, query, want):
    assert one(spark, query, X.keywordish) is want


def test_words_drop_stopwords_and_keep_repeats(spark):
    assert one(spark, "The cat and THE Cat_2, été x", X.words) == ["cat", "cat_2", "été"]


def test_trim_boundary(spark):
    assert one(spark, "  a\n\n b\t", lambda c: X.trim_boundary(c, 10)) == "a b"
    assert one(spark, "hello wide world", lambda c: X.trim_boundary(c, 12)) == "hello wide..."
    assert one(spark, "abcdefghij", lambda c: X.trim_boundary(c, 4)) == "abcd..."


def test_best_quote_centres_on_the_first_term(spark):
    text = "x " * 300 + "needle " + "y " * 300
    got = spark.createDataFrame([(text, "Needle zzz")], "t string, q string").select(X.best_quote(F.col("t"), F.col("q"))).first()[0]
    assert got.startswith("...") and got.endswith("...") and "needle" in got and len(got) <= 366
    assert one(spark, " \n ", lambda c: X.best_quote(c, F.lit("a"))) is None


def test_titles(spark):
    def title(content, path, fallback=""):
        return spark.createDataFrame([(content, path, fallback)], "c string, p string, f string").select(D.title(F.col("c"), F.col("p"), F.col("f"))).first()[0]

    assert title("x\n#  Head \n", "a/b.md") == "Head"
    assert title("#\n\nFoo", "a/b.md") == "Foo"
    assert title("## no", "a/b.c.md") == "b.c"
    assert title("## no", "a/b.md", "Front") == "Front"
    assert title("# x", "a/b.PY") == "b.PY"
    assert title("a\u2028# x", "b.md") == "b"


def test_breadcrumb_takes_the_last_three(spark):
    piece = "# A\n## B \n text\n### C\n#### D\n#nope"
    got = spark.createDataFrame([(piece, "T"), ("plain", "T")], "p string, t string").select(D.breadcrumb(F.col("p"), F.col("t"))).collect()
    assert [r[0] for r in got] == ["B > C > D", "T"]


def test_front_matter():
    f = D.split_front_matter("---\nname: A  b\ndescription: d\naliases: [x, '', 3]\nstatus: Superseded\nas_of: 2024-01-01\n---\nBody")
    assert (f["title"], f["summary"], f["aliases"], f["status"], f["as_of"], f["body"]) == ("A b", "d", ["x", "3"], "superseded", "2024-01-01", "Body")
    for plain in ("---\n: [\n---\nx", "---\n- a\n---\nx", "no", "--- \nx: 1\n", ""):
        assert D.split_front_matter(plain)["body"] == plain
    assert D.split_front_matter("---\naliases: one\n---")["aliases"] == ["one"]


def test_alias_names(spark):
    row = spark.createDataFrame([("Meta", ["T", "t", "Meta", "Other", ""], "T")], "m string, a array<string>, t string")
    assert row.select(D.alias_names(F.col("m"), F.col("a"), F.col("t"))).first()[0] == "Meta; Other"
