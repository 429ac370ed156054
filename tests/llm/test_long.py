"""Every query on a table with a text of a megabyte, and its copy."""

import random

import pytest

import corpus_pipeline
from lodestone.llm.queries import QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(8)
    some = lambda n: " ".join("".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(2, 9))) + r.choice(["", "", "", "\n"]) for _ in range(n))
    item = some(40).replace("\n", "")
    long = some(80_000) + "\n" + item + "\n" + some(80_000)
    assert len(long) > 1 << 20
    rows = [(0, long, "xx", "s1", len(long)), (1, long, "xx", "s2", len(long)), (2, None, None, None, 0), (3, "", "de", "s1", 0)]
    rows += [(k, some(120), "en" if k % 2 else "de", "s1", 0) for k in range(4, 30)]
    at = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_long_text(spark, tables, name):
    rows = QUERIES[name](spark, tables).collect()
    by = {x.doc_id: x.asDict() for x in rows}
    assert set(by) == set(range(30)) and (len(rows) == 30 or name == "op1_best_fit_packing")
    a, b = by[0], by[1]
    n = {"op4_suffix_array_dedup": "n_bytes", "op6_substring_dedup": "n_words"}.get(name)
    if n:
        assert a["n_removed"] == b["n_removed"] == a[n] > 0 and a["n_spans"] == 1 and not any(by[k]["n_removed"] for k in range(2, 30))
    if name == "op2_line_dedup":
        # of the first some lines of a word or two come again
        assert a["n_removed"] < a["n_lines"] / 20 and b["n_removed"] == b["n_lines"] > 20_000
    if name == "op3_benchmark_decontamination":
        assert a["n_hit"] == b["n_hit"] == 40 and a["n_words"] > 160_000 and not a["contaminated"]
    if name == "op8_simhash_near_dedup":
        assert a["component_id"] == b["component_id"] == 0 and a["fingerprint"] == b["fingerprint"]
    if name == "op9_token_output":
        assert a["n_tokens"] == b["n_tokens"] > 160_000 and b["start"] == a["n_tokens"] and a["ids_crc32"] == b["ids_crc32"]


def test_pipeline_of_a_long_text(spark, tables):
    left = {x.doc_id for x in corpus_pipeline.run(spark, tables).collect()}
    assert 0 in left and not {1, 2, 3} & left
