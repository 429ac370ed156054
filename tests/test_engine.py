import os
import subprocess
import sys
import threading

import pytest

from lodestone.operators import evaluate, incremental
from lodestone.plans import cli
from lodestone.plans.engine import Engine
from lodestone.settings import BusyError, CorruptIndexError, NotFoundError, OperationError, ReadError, ReindexError, Settings, distinct_targets
from lodestone.sources import kb, store
from lodestone.sources.paths import IgnoreRules, excluded, spelled
from lodestone.streaming import updates


def put(root, **files):
    for name, text in files.items():
        p = root / name.replace("__", "/").replace("_DOT_", ".")
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text.encode())


@pytest.fixture
def root(tmp_path):
    r = tmp_path / "kb"
    put(
        r, guide__models_DOT_md="---\ntitle: Models\naliases: [vector model]\n---\n# Embedding model\n\nThe embedding model turns text into vectors.\n",
        guide__old_DOT_md="---\nstatus: superseded\n---\n# Embedding model of old\n\nThe embedding model turned text into vectors.\n",
        index_DOT_md="# Index\n\nembedding model\n", code_DOT_py="def embed():\r\n    return 1\r\n", _draft_DOT_md="# Draft\n\nspare notes\n", blank_DOT_md=" \n",
    )
    (r / ".hidden.md").write_text("# no")
    (r / "skip").mkdir()
    (r / "skip" / "a.md").write_text("# Skipped")
    (r / "skip" / "keep.md").write_text("# Kept")
    (r / ".lodestoneignore").write_text("skip/*\n!skip/keep.md\n")
    return r


def test_scan_shows_underscores_and_hides_dots(root):
    assert sorted(kb.walk(root)) == ["_draft.md", "blank.md", "code.py", "guide/models.md", "guide/old.md", "index.md", "skip/keep.md"]
    assert list(kb.walk(root, "guide")) == ["guide/models.md", "guide/old.md"]
    assert list(kb.walk(root, "..")) == []
    assert list(kb.walk(root, "nope")) == []


def test_data_source(spark, root):
    rows = {r.path: r for r in kb.files(spark, root).collect()}
    assert rows["blank.md"].capture == "empty" and rows["code.py"].content == "def embed():\n    return 1\n"
    assert rows["code.py"].content_sha == kb.hash_file(root / "code.py") and rows["code.py"].size == os.path.getsize(root / "code.py")
    (root / "bad.md").write_bytes(b"\xff\xfe")
    with pytest.raises(ReadError):
        kb.read_file(root, "bad.md")
    with pytest.raises(ReadError):
        kb.read_file(root, "gone.md")


def test_a_large_folder_is_many_tasks(spark, tmp_path):
    for i in range(1201):
        (tmp_path / f"f{i}.md").write_text(f"# {i}")
    found = kb.files(spark, tmp_path)
    assert found.count() == 1201 and found.rdd.getNumPartitions() == 3
    (tmp_path / "none").mkdir()
    assert kb.files(spark, tmp_path / "none").count() == 0


@pytest.mark.parametrize(
    "rules, path, want",
    [("*.md", "a/b.md", True), ("/b.md", "a/b.md", False), ("/b.md", "b.md", True), ("a/", "a/b.md", True), ("a/", "a", False), ("**/x/*.py", "p/q/x/a.py", True),
     ("a/**", "a/b/c.md", True), ("*.md\n!b.md", "b.md", False), ("a/\n!a/b.md", "a/b.md", True), ("a?c.md", "abc.md", True), ("[ab].md", "c.md", False), ("#x\n\\#y", "#y", True)],
)
def test_ignore_rules(rules, path, want):
    assert IgnoreRules(rules).ignored(path) is want


def test_capture_of_an_inventory(spark, root):
    """Files as the inventory has them, those left out by now marked, and changed ones refused."""
    before = spark.createDataFrame(kb.files(spark, root).select("path", "content_sha").collect(), "path string, content_sha string")
    got = {r.path: (r.capture, r.content) for r in kb.capture(spark, root, before).collect()}
    assert got["blank.md"][0] == "empty" and got["guide/old.md"] == ("captured", "---\nstatus: superseded\n---\n# Embedding model of old\n\nThe embedding model turned text into vectors.\n")
    (root / ".lodestoneignore").write_text("skip/*\n!skip/keep.md\nguide/old.md\n")
    (root / "index.md").unlink()
    got = {r.path: r.capture for r in kb.capture(spark, root, before).collect()}
    assert got["guide/old.md"] == got["index.md"] == "excluded" and got["guide/models.md"] == "captured" and len(got) == before.count()
    assert not {"guide/old.md", "index.md"} & {r.path for r in kb.documents(kb.capture(spark, root, before), "c").collect()}
    (root / "guide" / "models.md").write_text("# Other")
    with pytest.raises(Exception, match="not what the inventory says"):
        kb.capture(spark, root, before).collect()


def test_links_out_of_the_root_are_excluded(root, tmp_path):
    (tmp_path / "out.md").write_text("# out")
    (root / "link.md").symlink_to(tmp_path / "out.md")
    assert excluded(root / "link.md", root) and "link.md" not in list(kb.walk(root))


def test_spelling(root):
    assert spelled(root, "GUIDE/Models.md") == "guide/models.md"
    with pytest.raises(FileNotFoundError):
        spelled(root, "guide/none.md")


def test_search_modes_and_life_cycle(spark, root, tmp_path):
    e = Engine(spark, Settings(index_root=str(tmp_path / "ix")), {"kb": root})
    first = e.reindex()["kb"]
    assert first.documents == 6 and e.reindex()["kb"].generation == first.generation
    text = e.results_text("embedding model", "keyword")
    assert text.index("guide/models.md") < text.index("guide/old.md") < text.index("index.md")
    for mode in ("semantic", "hybrid"):
        assert "guide/models.md" in e.results_text("embedding model", mode, 5)
    answer = e.search_text("vector model", 5)
    assert "### 1. Embedding model" in answer and "## Suggested Follow-ups" in answer
    assert "No results found." in e.search_text("  ")
    assert "**Reason:** keyword query had no meaningful BM25 hits" in e.search_text("zebra")
    assert e.results_text("embedding", "keyword", path_prefix="index") .count("**Path:**") == 1
    assert e.get_document("code.py").endswith("return 1\n")
    for bad in ("../x.md", ".hidden.md", "skip/a.md", "nope.md", "/etc/passwd"):
        with pytest.raises(NotFoundError):
            e.get_document(bad)
    ok, found = e.doctor()
    assert ok and found[0].state == "healthy"
    (root / "guide" / "new.md").write_text("# New\n\nzebra crossing\n")
    (root / "index.md").unlink()
    assert e.doctor(None)[1][0].state == "stale"
    second = e.reindex()["kb"]
    assert second.generation != first.generation and second.documents == 6
    assert "guide/new.md" in e.results_text("zebra crossing", "keyword")
    _, made, _ = store.load(spark, e.collections["kb"].location)
    fresh = Engine(spark, Settings(index_root=str(tmp_path / "ix2")), {"kb": root})
    fresh.reindex(force=True)
    _, whole, _ = store.load(spark, fresh.collections["kb"].location)
    for name in ("chunks", "postings", "term_df", "stats", "vectors"):
        a, b = getattr(made, name), getattr(whole, name)
        assert not a.exceptAll(b.select(*a.columns)).count() and not b.select(*a.columns).exceptAll(a).count()
    e.reindex(force=True)
    assert len([p for p in (tmp_path / "ix").iterdir() if p.name.startswith("gen-")]) == 2
    other = Engine(spark, Settings(index_root=str(tmp_path / "ix"), chunk_size=700), {"kb": root})
    assert other.doctor(None)[1][0].state == "incompatible"
    (tmp_path / "ix" / "CURRENT").write_text("../evil")
    assert e.doctor(None)[1][0].state == "corrupt"
    assert e.reindex()["kb"].documents == 6


def test_collections(spark, root, tmp_path):
    b = tmp_path / "b"
    put(b, other_DOT_md="# Embedding model\n\nanother embedding model page\n")
    e = Engine(spark, Settings(index_root=str(tmp_path / "ix")), {"a": root, "b": b})
    hits, route = e.search("embedding model", top_k=4)
    assert {r.collection for r in hits.collect()} == {"a", "b"} and route.count() == 1
    assert "**Collection:** b" in e.results_text("embedding model", "keyword", collection="b")
    with pytest.raises(OperationError):
        e.resolve("B")
    assert [c.name for c in e.resolve("ALL")] == ["a", "b"]
    assert [s["documents"] for s in e.stats()] == [6, 1]
    assert {r.collection for r in e.list_documents(extension="md").collect()} == {"a", "b"}
    assert [r.path for r in e.list_documents("a", folder="GUIDE").collect()] == ["guide/models.md", "guide/old.md"]
    (b / "bad.md").write_bytes(b"\xff")
    with pytest.raises(ReindexError) as x:
        e.reindex()
    assert x.value.completed == ["a"] and set(x.value.failed) == {"b"}
    with pytest.raises(ValueError):
        distinct_targets({"x": tmp_path, "y": tmp_path})


def test_lock(tmp_path):
    with store.writer_lock(tmp_path):
        with store.writer_lock(tmp_path):
            pass
        caught = []

        def other():
            try:
                with store.writer_lock(tmp_path):
                    pass
            except BusyError as x:
                caught.append(str(x))

        t = threading.Thread(target=other)
        t.start()
        t.join()
        assert caught and str(os.getpid()) in caught[0]


def test_pointer_and_manifest(tmp_path):
    assert store.read_pointer(tmp_path) is None and store.read_manifest(tmp_path) is None
    (tmp_path / "CURRENT").write_text("gen-1")
    with pytest.raises(CorruptIndexError):
        store.read_manifest(tmp_path)
    for text in ("{", "{}", '{"version": 9}'):
        with pytest.raises(CorruptIndexError):
            store.Manifest.decode(text)


def test_generations_without_rank_terms_are_read(spark, tmp_path):
    """What the first version published is searched as a new index is; others are refused."""
    import json
    import shutil

    from lodestone import catalogue
    from lodestone.operators import bm25

    made = catalogue.index(spark, "/root/testdata/sf0.001")
    sources = incremental.inventory(catalogue._files(catalogue.docs(spark, "/root/testdata/sf0.001")))
    name = store.publish(tmp_path, "c", made, sources, Settings(stem=False)).generation
    asked = catalogue.asked(spark, "/root/testdata/sf0.001").limit(20)
    found = lambda index: sorted(map(tuple, bm25.keyword_search(index, asked, 5).select("qid", "path", "rank", "score", "overlap").collect()))
    new = store.load(spark, tmp_path)[1]
    want = found(new)
    assert new.facts is not None and want == found(made)
    manifest = json.loads((tmp_path / name / "manifest.json").read_text())
    (tmp_path / name / "manifest.json").write_text(json.dumps(manifest | {"version": 1}))
    shutil.rmtree(tmp_path / name / "rank_terms")
    old = store.load(spark, tmp_path)[1]
    assert old.facts is None and found(old) == want
    (tmp_path / name / "manifest.json").write_text(json.dumps(manifest))
    with pytest.raises(CorruptIndexError):
        store.load(spark, tmp_path)


def test_change_detection(spark):
    kind = "path string, content_sha string"
    a = spark.createDataFrame([("same", "1"), ("edit", "1"), ("gone", "1"), ("blank", "")], kind)
    b = spark.createDataFrame([("same", "1"), ("edit", "2"), ("new", "1"), ("blank", "")], kind)
    got = {r.path: r.change for r in incremental.change_detect(a, b).collect()}
    assert got == {"same": "unchanged", "edit": "changed", "gone": "removed", "new": "added", "blank": "changed"}


def test_regression_gate(spark):
    kind = "query_id string, top_1_path_hit boolean, top_5_path_hit boolean, path_reciprocal_rank double, latency_ms double"
    base = spark.createDataFrame([(str(i), True, True, 1.0, 1.0) for i in range(20)], kind)
    now = spark.createDataFrame([(str(i), i > 1, True, 1.0, 2.0) for i in range(20)], kind)
    r = evaluate.compare(base, now, True)
    assert r.failed and r.lost == ["0", "1"] and len(r.reasons) == 3
    assert not evaluate.compare(base, base).failed and evaluate.consistent(base, base)
    with pytest.raises(ValueError):
        evaluate.compare(base, now.limit(3))


@pytest.mark.parametrize("kw", [{"chunk_size": 0}, {"chunk_size": 10001}, {"overlap": -1}, {"model": "x"}, {"log_level": "LOUD"}])
def test_settings_are_checked(kw):
    with pytest.raises(ValueError):
        Settings(**kw)


def test_collection_settings(tmp_path):
    (tmp_path / "a").mkdir()
    assert list(Settings(collections=f"x:{tmp_path}/a, y:{tmp_path}").resolved_collections()) == ["x", "y"]
    assert list(Settings(kb_path=str(tmp_path / "a")).resolved_collections()) == ["a"]
    for bad in ({}, {"kb_path": "/x", "collections": "a:b"}, {"collections": f"all:{tmp_path}"}, {"collections": f"a:{tmp_path},a:{tmp_path}"}, {"collections": "a:/none"}, {"collections": "a"}):
        with pytest.raises(ValueError):
            Settings(**bad).resolved_collections()
    assert Settings.from_env({"LODESTONE_CHUNK_SIZE": "900", "LODESTONE_STEM": "no"}).chunk_size == 900


def test_command_line(spark, root, tmp_path, capsys):
    e = Engine(spark, Settings(index_root=str(tmp_path / "ix")), {"kb": root})
    for args in (["reindex"], ["keyword", "embedding model", "--top-k", "2"], ["list"], ["stats"], ["doctor"], ["get", "code.py"], ["collections"]):
        assert cli.run(args, e, sys.stdout) == 0
    said = capsys.readouterr().out
    assert "6 documents" in said and "healthy" in said and "BM25 Score" in said
    assert cli.run(["get", "nope.md"], e) == 2
    assert cli.run(["keyword", "x", "--extension", ","], e) == 2


def test_update_stream(spark, tmp_path):
    inbox, root = tmp_path / "in", tmp_path / "ix"
    inbox.mkdir()

    def feed(name, *rows):
        import json

        with open(inbox / name, "w") as f:
            for path, content, mtime in rows:
                f.write(json.dumps({"collection": "c", "path": path, "title": path, "folder": "", "extension": ".md", "mtime": mtime, "content": content}) + "\n")
        q = updates.maintain(updates.read_documents(spark, f"file://{inbox}"), root, "c", Settings(), f"file://{tmp_path}/cp")
        q.awaitTermination()

    feed("1.json", ("a.md", "alpha beta", 1.0), ("b.md", "gamma", 1.0))
    feed("2.json", ("a.md", "alpha delta", 2.0), ("b.md", None, 2.0), ("c.md", "omega", 2.0))
    manifest, made, sources = store.load(spark, root)
    assert manifest.documents == 2 and {r.path for r in sources.collect()} == {"a.md", "c.md"}
    terms = {r.term for r in made.term_df.collect()}
    assert "delta" in terms and "omega" in terms and "beta" not in terms and "gamma" not in terms


def test_nothing_else_imports_the_corpus_operators():
    code = "import sys; sys.path.insert(0, '.'); import lodestone.catalogue, lodestone.plans.cli, lodestone.streaming.updates; assert not any(m.startswith('lodestone.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_intermediate_tables(spark):
    from lodestone import runtime

    df = runtime.written(spark.range(3).toDF("a"), "t")
    assert df.count() == 3 and runtime.scratch(spark) in df.inputFiles()[0].replace("file:///", "file:/").replace("file:/", "file:///")
    runtime.discard(df)
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()
