import json

import pytest

from lodestone.plans import evaluation as E
from lodestone.plans.engine import Engine
from lodestone.settings import Settings

GOLD = """
version: '1.0'
queries:
- {id: a, query: alpha particles, category: x, expected_path: A.md, expected_keywords: [alpha, 404], quick_set: true}
- {id: b, query: beta decay, category: x, expected_path: nope.md, alternate_paths: [sub/b.md], expected_keywords: [zzz], min_keywords: 1}
- {id: c, query: unknown zebra, category: y, expected_path: a.md}
- {id: d, query: gamma, category: y, expected_path: a.md, stress_set: true}
"""


@pytest.fixture
def world(spark, tmp_path):
    kb = tmp_path / "kb"
    (kb / "sub").mkdir(parents=True)
    (kb / "a.md").write_text("# Alpha particles\n\nalpha particles of code 404\n")
    (kb / "sub" / "b.md").write_text("# Beta decay\n\nbeta decay of things\n")
    (tmp_path / "g.yaml").write_text(GOLD)
    return Engine(spark, Settings(index_root=str(tmp_path / "ix")), {"kb": kb}), tmp_path


def test_scopes(tmp_path):
    (tmp_path / "g.yaml").write_text(GOLD)
    ids = lambda **kw: [g.id for g in E.load_golden(tmp_path / "g.yaml", E.Scope(**kw))]
    assert ids() == ["a", "b", "c"] and ids(quick=True) == ["a"] and ids(stress_only=True) == ["d"]
    assert ids(include_stress=True) == list("abcd") and ids(categories=("y",)) == ["c"]
    with pytest.raises(ValueError):
        ids(file_types=(".sql",))


@pytest.mark.parametrize(
    "bad", ["queries: []", "queries: [{id: a}]", "version: '2'\nqueries: []", "x: [", "queries: [{id: a, query: q, category: c, expected_path: ../x}]",
            "queries: [{id: a, query: q, category: c, expected_path: x, min_keywords: 1}]", "queries: [{id: a, query: q, category: c, expected_path: x, more: 1}]"],
)
def test_strict_input(tmp_path, bad):
    (tmp_path / "g.yaml").write_text(bad)
    with pytest.raises(ValueError):
        E.load_golden(tmp_path / "g.yaml")


def test_run_report_and_gate(spark, world):
    engine, tmp = world
    golden = E.load_golden(tmp / "g.yaml")
    rows = {r.query_id: r for r in E.run(engine, golden, "keyword").collect()}
    assert rows["a"].top_1_path_hit and rows["a"].top_1_keyword_hit and rows["a"].path_reciprocal_rank == 1
    assert rows["b"].top_1_path_hit and not rows["b"].top_5_keyword_hit and rows["b"].keywords_missing == ["zzz"]
    assert rows["c"].retrieved_path == "(no results)" and rows["c"].path_first_hit_rank is None
    rep = E.report(E.run(engine, golden, "adaptive"), E.manifest(engine, golden, E.Scope(), "adaptive"))
    assert rep["summary"]["queries"] == 3 and "MRR" in E.markdown(rep)
    base = E.promote(spark, rep, tmp / "base" / "b.json")
    again = E.load_report(spark, base)
    assert not E.gate(spark, again, rep).failed and E.differences(rep["manifest"], again["manifest"]) == []
    assert E.latest_baseline(tmp / "base", "adaptive") == base and E.latest_baseline(tmp / "base", "hybrid") is None
    worse = json.loads(json.dumps(rep))
    for r in worse["results"]:
        r["top_1_path_hit"] = False
    assert E.gate(spark, worse, rep).failed
    with pytest.raises(ValueError):
        E.promote(spark, worse, tmp / "no.json", rep)
    base.write_text(json.dumps({**rep, "summary": {**rep["summary"], "top_1": 0.123}}))
    with pytest.raises(ValueError):
        E.load_report(spark, base)
    with pytest.raises(ValueError):
        E.differences({**rep["manifest"], "corpus": "x"}, rep["manifest"])


def test_suite(spark, world):
    _, tmp = world
    (tmp / "s.yaml").write_text("version: '1.0'\nmodes: [bm25]\nknowledge_bases:\n- {id: one, kb_path: kb, golden_queries: g.yaml, include_stress: true}\n")
    table, failures = E.battle(spark, tmp / "s.yaml", Settings(), tmp / "out")
    whole = [r for r in table.collect() if r.whole_mode == 1]
    assert len(whole) == 1 and whole[0].queries == 4 and not failures
    assert E.battle(spark, tmp / "s.yaml", Settings(), tmp / "out2", tmp / "out")[1] == []


def test_report_consistency_evaluates_once(spark, sf, monkeypatch):
    """Both sides of the comparison are read from one written evaluation, not made anew each time."""
    from lodestone import catalogue

    made = []
    monkeypatch.setattr(catalogue, "results", lambda s, _: s.range(6).selectExpr(
        "id as query_id", "concat('c', id % 2) as category", "id % 3 = 0 as top_1_path_hit", "true as top_5_path_hit", "id * 1.5D as latency_ms"))
    monkeypatch.setattr(catalogue, "written", lambda df, name, f=catalogue.written: made.append(name) or f(df, name))
    assert [tuple(r) for r in catalogue.report_consistency(spark, sf).collect()] == [("again", True, 2)]
    assert made == ["results"]
