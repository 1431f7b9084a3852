"""Corpus scan, keyed tables, incremental index and reports."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lodeseek.plans.code_index import run_dry, run_index, sample_search
from lodeseek.operators import filters
from lodeseek.operators.chunking import embed_input, heading_path
from lodeseek.sources.files import code_files, default_graph_schema, failed_chunks, graph_schema, json_lines, markdown_docs, CODE_ITEM
from lodeseek.sources.tables import code_store


def write(base, files):
    for name, body in files.items():
        path = os.path.join(base, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as out:
            out.write(body if isinstance(body, bytes) else body.encode())


@pytest.fixture
def tree(tmp_path):
    base = str(tmp_path / "code tree+1")
    write(base, {
        "a.py": "def foo():\n    return 1\n", "sub/b.js": "export function greet() {}\n", ".venv/lib.py": "x",
        "node_modules/x.js": "x", "readme.md": "# r", "big.min.js": "x", "deep/er/explain/data.js": "x", "explain/other.js": "y",
        "empty.py": "", "huge.py": "x" * 1_200_000, "types.d.ts": "x", "UP.PY": "z = 1\n", "bad.py": b"s = '\xff'\n",
    })
    return base


def test_scan_filters(spark, tree):
    rows = {r["path"]: r for r in code_files(spark, tree).collect()}
    assert sorted(rows) == ["UP.PY", "a.py", "bad.py", "explain/other.js", "sub/b.js"]
    import hashlib
    assert rows["a.py"]["sha256"] == hashlib.sha256(b"def foo():\n    return 1\n").hexdigest()
    assert rows["sub/b.js"]["lang"] == "javascript" and rows["UP.PY"]["lang"] == "python"
    assert rows["bad.py"]["content"] == "s = '�'\n"
    assert "explain/other.js" not in {r["path"] for r in code_files(spark, tree, globs=["explain/*.js"]).collect()}
    with pytest.raises(FileNotFoundError):
        code_files(spark, tree + "-none")


def test_component_order(spark):
    df = spark.createDataFrame([("a/z.py",), ("a-b/c.py",), ("a/b/c.py",)], "rel_path string")
    assert [r[0] for r in filters.first_files(df, 2).collect()] == ["a/b/c.py", "a/z.py"]
    assert filters.first_files(df, None).count() == 3


def test_incremental_run(spark, tree, tmp_path):
    store = str(tmp_path / "store")
    first = run_index(spark, tree, store, "2026-01-01T00:00:00+00:00").first()
    assert (first["files_scanned"], first["files_indexed"], first["files_unchanged"], first["files_removed"]) == (5, 5, 0, 0)
    assert first["files_by_lang"] == {"python": 3, "javascript": 2} and first["total_chunks"] == code_store(spark, store).read("code_chunks").count()
    assert first["chunks_by_dir"]["sub"] == 1
    write(tree, {"a.py": "def foo():\n    return 2\n\ndef new():\n    pass\n", "c.py": "y = 1\n"})
    os.remove(os.path.join(tree, "sub/b.js"))
    second = run_index(spark, tree, store, "2026-01-02T00:00:00+00:00").first()
    assert (second["files_scanned"], second["files_indexed"], second["files_unchanged"], second["files_removed"]) == (5, 2, 3, 1)
    rows = {r["chunk_id"]: r for r in code_store(spark, store).read("code_chunks").collect()}
    assert "a.py#new#4" in rows and not any(k.startswith("sub/b.js") for k in rows)
    assert rows["a.py#foo#1"]["document"].endswith("return 2") and all(r["signature"] is not None for r in rows.values())
    stamps = {r["path"]: r["indexed_at"] for r in code_store(spark, store).read("file_manifest").collect()}
    assert stamps["UP.PY"].startswith("2026-01-01") and stamps["a.py"].startswith("2026-01-02")
    # A limit narrows what is indexed, not what exists.
    write(tree, {"a.py": "z = 3\n", "zz.py": "late = 1\n"})
    third = run_index(spark, tree, store, "2026-01-03T00:00:00+00:00", limit=2).first()
    assert third["files_removed"] == 0
    paths = {r["path"] for r in code_store(spark, store).read("file_manifest").collect()}
    assert {"UP.PY", "a.py", "bad.py", "c.py", "explain/other.js"} == paths
    lines = [json.loads(l) for f in sorted(os.listdir(os.path.join(store, "chunks-manifest"))) if f.endswith(".json")
             for l in open(os.path.join(store, "chunks-manifest", f), encoding="utf-8")]
    ids = [l["chunk_id"] for l in lines]
    assert ids == sorted(ids) and len(ids) == third["total_chunks"]
    found = sample_search(spark, store, spark.createDataFrame([(1, "return 2 foo late")], "query_id long, query string"), 3)
    assert found.count() == 3
    dry = run_dry(spark, tree, store, "2026-01-04T00:00:00+00:00").first()
    assert dry["mode"] == "dry-run" and dry["files_scanned"] == 6 and dry["prospective_chunks"] >= 6
    full = run_index(spark, tree, store, "2026-01-05T00:00:00+00:00", full=True).first()
    assert full["files_indexed"] == 6 and full["files_unchanged"] == 0


def test_embed_input(spark):
    df = spark.createDataFrame([("a.py", "python", "def f()", 'def f():\n    """Doc."""', "Doc."), ("b.js", "javascript", "", "x", "")],
                               "path string, lang string, signature string, text string, doc string")
    got = [r["embed_text"] for r in embed_input(df).orderBy("path").collect()]
    assert got == ['# path: a.py\n# signature: def f()\n# doc: Doc.\ndef f():\n    """Doc."""', "# path: b.js\nx"]


def test_markdown_and_json_sources(spark, tmp_path):
    write(str(tmp_path), {"02.b.md": "# B", "01.a.md": "# A\ntext", "x.txt": "no"})
    docs = markdown_docs(spark, str(tmp_path)).orderBy("path").collect()
    assert [d["source"] for d in docs] == ["01.a", "02.b"] and docs[0]["text"] == "# A\ntext"
    items = tmp_path / "items.jsonl"
    items.write_text('{"id": "q1", "query": "무엇", "gt_chunk_ids": ["a"]}\n\n{"id": "q2"}\n', encoding="utf-8")
    got = json_lines(spark, str(items), CODE_ITEM).collect()
    assert [r["id"] for r in got] == ["q1", "q2"] and got[0]["gt_chunk_ids"] == ["a"]
    assert failed_chunks(spark, str(tmp_path / "none")).count() == 0
    report = tmp_path / "report.json"
    report.write_text('{"chunk_id": "c1", "reason": "parse_error"}\nnot json\n{"reason": "x"}\n')
    assert [r[0] for r in failed_chunks(spark, str(report)).collect()] == ["c1"]
    types, triples, props = graph_schema(spark, default_graph_schema())
    assert len(types) == 5 and triples.count() == 14 and props == ["description"]


def test_request_rules(spark):
    df = spark.createDataFrame([("q", None), ("q", "gemini"), ("", None), ("q", "other"), (None, None)], "q string, h string")
    assert [r[0] for r in df.select(filters.valid_request("q", "h")).collect()] == [True, True, False, False, False]
    labels = spark.createDataFrame([(["hyde", "magic", "step_back"],)], "t array<string>")
    assert labels.select(filters.known_techniques("t")).first()[0] == ["hyde", "step_back"]
    heads = spark.createDataFrame([("a", "", "c", None)], "h1 string, h2 string, h3 string, h4 string")
    assert heads.select(heading_path("h1", "h2", "h3", "h4")).first()[0] == "a > c"


def test_select_chunks(spark):
    df = spark.createDataFrame([(n, f"chunk_{n}") for n in range(5)], "seq long, chunk_id string")
    only = spark.createDataFrame([("chunk_4",), ("chunk_1",), ("chunk_3",), ("nope",)], "chunk_id string")
    assert [r["seq"] for r in filters.select_chunks(df, only, 2).collect()] == [1, 3]
    assert filters.select_chunks(df, None, 0).count() == 5


def test_excluded_files_are_pruned_while_listing(spark, tmp_path):
    from lodeseek.sources.files import code_files

    for name in ("a.py", "node_modules/b.py", "src/d e.ts", "x.bin"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x = 1\n")
    files = code_files(spark, str(tmp_path))
    assert {r["path"] for r in files.collect()} == {"a.py", "src/d e.ts"}
    plan = files._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().head()
    assert "number of files read" in scan.metrics().apply("numFiles").toString() and scan.metrics().apply("numFiles").value() == 2
