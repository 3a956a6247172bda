import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from thicket.model import FindRequest, OverviewRequest, ReferencesRequest, SafeError, Scope, ValidationError
from thicket.operators import combine, tree
from thicket.plans.adapters import ADAPTERS
from thicket.plans.engine import Engine
from thicket.sources import cache, parsers, workspace
from thicket.streaming import progress, watch


@pytest.fixture
def root(tmp_path):
    for name, content in {
        "pkg/kept.py": "a\nb\n", "pkg/__init__.py": "x", ".hidden/nested/ignored.py": "y", "build/out.py": "z", "README.md": "# T", "b.PY": "q",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    return workspace.workspace_root(str(tmp_path))


def test_listing(spark, root):
    python = ADAPTERS["python"]
    assert workspace.list_files(root, "", python.extensions, python.ignores) == ["b.PY", "pkg/__init__.py", "pkg/kept.py"]
    assert workspace.list_files(root, ".hidden", python.extensions, python.ignores) == [".hidden/nested/ignored.py"]
    assert workspace.scope_files(root, Scope("README.md", False), python.extensions) == []
    assert workspace.workflow_files(root, "pkg/__init__.py", python.extensions) == ["pkg/kept.py", "pkg/__init__.py"]
    read = {r.file: r for r in workspace.read_files(spark, root, ["pkg/__init__.py", "b.PY"]).collect()}
    assert (read["pkg/__init__.py"].content, read["b.PY"].ext) == ("x", ".py")


def test_paths_and_scopes(root):
    assert workspace.resolve_scope(root, ".").path == ""
    assert workspace.resolve_scope(root, "pkg/../pkg").path == "pkg"
    assert workspace.resolve_scope(root, "README.md").is_dir is False
    for bad, message in (("../x", "escapes workspace root"), ("/etc", "must be workspace-relative"), ("none", "not found")):
        with pytest.raises(SafeError, match=message):
            workspace.resolve_scope(root, bad)
    with pytest.raises(SafeError, match="points to a directory"):
        workspace.document_path(root, "pkg")
    with pytest.raises(SafeError, match="must be absolute"):
        workspace.workspace_root("x")


def test_registry(spark):
    with pytest.raises(ValueError, match="belongs to"):
        workspace.register({"a": [".x"], "b": [".X"]})
    with pytest.raises(ValueError, match="empty extension"):
        workspace.register({"a": [""]})
    known = workspace.register({"a": [".x", ".X"], "b": [".y"]})
    assert workspace.adapters_of(spark.createDataFrame([("f.X",), ("g.z",)], "file string"), known) == ["a"]
    with pytest.raises(SafeError, match='extension ".q" are not supported'):
        workspace.adapter_of_file("a.q", known)
    with pytest.raises(SafeError, match="file with extension"):
        workspace.adapter_of_file("a", known)


def test_constants_and_brackets(spark):
    php = "<?php\nconst A = 1;\nclass B {\n  const INNER = 2;\n}\n}}\n  const C2 = 3;\nconst É1 = 1;\n"
    rows = parsers.constants(spark.createDataFrame([("a.php", php)], "file string, content string")).orderBy("first_line").collect()
    assert [(r.name_path, r.first_line, r.declaration) for r in rows] == [("A", 1, "const A = 1;"), ("C2", 6, "const C2 = 3;"), ("É1", 7, "const É1 = 1;")]


def test_reexports():
    content = 'export { default as defaultBucket, createModuleBucket as aliasBucket, defaultLabel } from "./module_contracts";\nexport type { Shape } from "./s";\nexport { a } from "b"\n'
    got = parsers.parse_reexports(content)
    assert [(r[0], r[1], r[2]) for r in got] == [("defaultBucket", "default", "./module_contracts"), ("aliasBucket", "createModuleBucket", "./module_contracts"), ("defaultLabel", "defaultLabel", "./module_contracts"), ("Shape", "Shape", "./s")]
    assert got[0][7:] == (0, content.index("defaultBucket"))


def test_reference_table(spark):
    text = ["+--+", "| Path | LN | a | b |", "| x.php | 7 | - | - |", "| x.php | 11 | - | - |", "| x.php | 7 | - | - |"]
    df = spark.createDataFrame([(x,) for x in text], "value string")
    assert sorted(r.line for r in parsers.reference_table(df).collect()) == [6, 10]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        parsers.reference_table(spark.createDataFrame([("| x | y | - | - |",)], "value string")).collect()


def test_compile_database(spark, tmp_path):
    commands = json.dumps([{"directory": "build", "file": "a.c"}, {"directory": "/abs", "file": "b.c"}, {"directory": "", "file": "c.c"}])
    r = spark.createDataFrame([(commands,)], "t string").select(parsers.compile_commands(F.col("t"), "/w").alias("x")).first()
    assert [c["directory"] for c in json.loads(r.x)] == ["/w/build", "/abs", "/w"]
    assert parsers.compilation_database(str(tmp_path)) is None
    (tmp_path / "compile_flags.txt").write_text("-O2")
    assert parsers.compilation_database(str(tmp_path)) == "compile_flags.txt"
    found = parsers.config_fragments("If:\n  PathMatch: [src/.*, 'lib/.*']\n  PathExclude: .*\\.h\nCompileFlags:\n  CompilationDatabase: None\n---\nCompileFlags:\n  Add:\n    - -W\n")
    assert [parsers.fragment_applies(found[0], f) for f in ("src/a.c", "src/a.h", "x.c")] == [True, False, False]
    assert found[1] == {"CompileFlags": {"Add": ["-W"]}}


def test_cache(spark, tmp_path):
    def files(*rows):
        return spark.createDataFrame([*rows], "file string, content_hash string")

    policy = cache.clangd_policy([".clangd"], None, False, fingerprint="v1")
    old = cache.entries(files(("a.c", "1"), ("b.c", "2"), (".clangd", "9")), policy, "w").where("file <> '.clangd'").withColumn("payload", F.lit("tree"))
    cache.store(old, str(tmp_path / "c"))
    held = cache.load(spark, str(tmp_path / "c"))
    now = cache.entries(files(("a.c", "1"), ("b.c", "3"), (".clangd", "9")), policy, "w").where("file <> '.clangd'")
    assert [r.file for r in cache.stale(held, now).collect()] == ["b.c"]
    assert [r.file for r in cache.valid(held, now).collect()] == ["a.c"]
    other = cache.entries(files(("a.c", "1"), (".clangd", "8")), policy, "w").where("file <> '.clangd'")
    assert cache.valid(held, other).count() == 0
    assert not cache.clangd_policy([], [], True).enabled


def test_watch(spark, tmp_path):
    rows = [("a", "write", False, 1, 1), ("b", "remove", False, 1, 2), ("d", "create", True, 1, 3), ("../x", "write", False, 1, 4), ("a", "rename", False, 2, 5), ("c", "create", False, 3, 6), ("e", "none", False, 1, 7)]
    e = spark.createDataFrame(rows, "path string, op string, is_dir boolean, ts int, seq int")
    assert {(r.path, r.change) for r in watch.last_change(watch.file_events(e)).collect()} == {("a", "deleted"), ("b", "deleted"), ("c", "created")}
    assert [r.path for r in watch.new_folders(e).collect()] == ["d"]
    e.write.parquet(str(tmp_path / "in"))
    seen = []
    q = watch.follow(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), lambda df, n: seen.extend(r.path for r in df.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == ["a", "b", "c"]


PROGRESS = [("w", "1", "report", "other", "", 1), ("w", "2", "begin", "Indexing", "", 2), ("w", "1", "end", "", "", 3), ("v", "1", "begin", "x", "background INDEX", 1), ("v", "1", "end", "", "", 2), ("u", "1", "begin", "load", "", 1), ("w", "2", "report", "", "half", 4)]


def test_progress_batch_and_stream(spark, tmp_path):
    e = spark.createDataFrame(PROGRESS, "workspace string, token string, kind string, title string, message string, seq int")
    want = {"w": "indexing", "v": "idle", "u": "unknown"}
    assert {r.workspace: r.state for r in progress.final_states(e).collect()} == want
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = progress.stream_states(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.workspace: r.state for r in spark.table("states").collect()} == want
    marked = progress.with_incomplete(spark.createDataFrame([("v",), ("z",)], "workspace string"), progress.final_states(e))
    assert {r.workspace: r.incomplete for r in marked.collect()} == {"v": False, "z": True}


def test_merging(spark):
    s = "name_path string, file string, first_line int, last_line int, kind int, body string, info string"
    a = spark.createDataFrame([("p", "f", 0, 1, 6, "", None)], s)
    b = spark.createDataFrame([("p", "f", 0, 1, 7, "body", "info"), ("q", "f", 0, 1, 7, None, None)], s)
    got = {r.name_path: (r.kind, r.body, r.info) for r in combine.merge_found([a, b]).collect()}
    assert got == {"p": (6, "body", "info"), "q": (7, None, None)}
    refs = spark.createDataFrame([("f", "p", 3), ("f", "p", 4), ("f", "q", 5)], "file string, name_path string, line int")
    base = refs.where("name_path = 'q'")
    assert sorted(r.line for r in combine.append_property_refs(base, refs, "f", 3).collect()) == [4, 5]


def test_validation():
    with pytest.raises(ValidationError) as e:
        FindRequest("", depth=-1, include_kinds=(0, 27)).validate()
    assert len(e.value.problems) == 4
    assert "symbol_query is required" in e.value.public("symbol_query")


def test_engine(spark):
    content = "package fixture\n\nfunc Use() {\n\tMakeBucket()\n}\n\nfunc MakeBucket() {}\n"
    at = lambda a, b, c, d: {"start": {"line": a, "character": b}, "end": {"line": c, "character": d}}
    raw = [("a.go", 0, {"name": "Use", "kind": 12, "range": at(2, 0, 4, 1), "selectionRange": at(2, 5, 2, 8)}), ("a.go", 1, {"name": "MakeBucket", "kind": 12, "range": at(6, 0, 6, 20), "selectionRange": at(6, 5, 6, 15)})]
    symbols = tree.flatten(spark.createDataFrame([(f, i, json.dumps(p)) for f, i, p in raw], "file string, seq int, payload string"), "go")
    files = spark.createDataFrame([("a.go", content), ("b.go", "x\n// MakeBucket\n")], "file string, content string")
    refs = spark.createDataFrame([("a.go", 6, 5, "a.go", 3, 1, 3, 0), ("a.go", 6, 5, "b.go", 1, 3, 1, 1)], "target_file string, target_line int, target_char int, ref_file string, line int, char int, end_line int, seq int")
    e = Engine(symbols, files, refs)
    assert json.loads(e.overview_json(OverviewRequest("a.go"))) == {"groups": [{"kind": 12, "symbols": [{"path": "Use", "range": "2-4"}, {"path": "MakeBucket", "range": "6"}]}]}
    found = json.loads(e.find_json(FindRequest("fixture.Use", include_body=True)))
    assert found == {"symbols": [{"kind": 12, "body": "func Use() {\n\tMakeBucket()\n}", "path": "Use", "file": "a.go", "range": "2-4"}]}
    out = json.loads(e.references_json(ReferencesRequest("MakeBucket", "a.go")))
    assert out == {"files": [
        {"file": "a.go", "symbols": [{"kind": 12, "path": "Use", "range": "2-4", "content": "func Use() {\n\tMakeBucket()\n}"}]},
        {"file": "b.go", "symbols": [{"kind": 1, "path": "b", "range": "0-2", "content": "x\n// MakeBucket\n"}]},
    ]}
    assert json.loads(e.references_json(ReferencesRequest("MakeBucket", "a.go", exclude_kinds=(12,))))["files"][0]["file"] == "b.go"
    with pytest.raises(SafeError):
        Engine(symbols, files, refs, budget=1).find_json(FindRequest("Use"))


def test_nothing_outside_imports_llm():
    here = os.path.join(os.path.dirname(__file__), "..", "thicket")
    for at, _, names in os.walk(here):
        if os.path.basename(at) != "llm":
            for n in names:
                if n.endswith(".py"):
                    assert "thicket.llm" not in open(os.path.join(at, n)).read(), n
    assert pd is not None


def test_stored_entries_stay_beside_new_ones(spark, tmp_path):
    path = str(tmp_path / "c")
    assert cache.load(spark, path).count() == 0

    def put(adapter, file, payload):
        files = spark.createDataFrame([(file, payload)], "file string, content_hash string")
        cache.store(cache.entries(files, cache.CachePolicy(adapter), "w").withColumn("payload", F.lit(payload)), path)

    for adapter, file, payload in (("go", "a", "1"), ("rust", "b", "2"), ("go", "c", "3"), ("go", "a", "4")):
        put(adapter, file, payload)
    want = {("go", "a", "4"), ("rust", "b", "2"), ("go", "c", "3")}
    assert {(r.adapter_id, r.file, r.payload) for r in cache.load(spark, path).collect()} == want
    cache.compact(spark, path, path + "2")
    assert spark.read.parquet(path + "2").count() == 3
    assert {(r.adapter_id, r.file, r.payload) for r in cache.load(spark, path + "2").collect()} == want
