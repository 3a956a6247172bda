import json
import random

import pytest
from pyspark.sql import functions as F

from thicket.functions import paths
from thicket.model import FindRequest, SafeError
from thicket.operators import references, search, tree


def at(sl, sc, el, ec):
    return {"start": {"line": sl, "character": sc}, "end": {"line": el, "character": ec}}


def symbol(name, kind, span, children=(), sel=None):
    sel = sel or (span[0], span[1])
    return {"name": name, "kind": kind, "range": at(*span), "selectionRange": at(*sel, sel[0], sel[1] + 1), "children": list(children)}


def table(spark, files, build="plain"):
    rows = [(f, i, json.dumps(s)) for f, roots in files.items() for i, s in enumerate(roots)]
    return tree.flatten(spark.createDataFrame(rows, "file string, seq int, payload string"), build)


SERVICE = [symbol("Service", 5, (0, 0, 20, 0), [symbol("GetSymbolsOverview", 6, (4, 0, 10, 0), [symbol("request", 13, (6, 0, 6, 7))])])]


def test_overview_depths(spark):
    t = table(spark, {"fixture.go": SERVICE})
    assert [(r.name_path, r.first_line, r.last_line) for r in search.overview(t, 0).collect()] == [("Service", 0, 19)]
    assert [(r.name_path, r.kind, r.first_line, r.last_line) for r in search.overview(t, 1).orderBy("rank").collect()][1] == ("Service/GetSymbolsOverview", 6, 4, 9)


def test_flat_symbols(spark):
    flat = {"name": "GetSymbolsOverview", "kind": 6, "containerName": " Service ", "location": {"uri": "x", "range": at(8, 2, 12, 0)}}
    r = table(spark, {"a.go": [flat]}).first()
    assert (r.name_path, r.first_line, r.last_line, r.sel_line) == ("Service/GetSymbolsOverview", 8, 11, 8)


def test_duplicates_rename_what_is_below(spark):
    twice = [symbol("notification", 13, (2, 14, 3, 0), [symbol("x", 13, (2, 15, 2, 16))]), symbol("notification", 13, (6, 10, 7, 0))]
    t = table(spark, {"a.ts": [symbol("execute", 12, (0, 0, 9, 0), twice)]})
    assert [r.name_path for r in t.orderBy("preorder").collect()] == ["execute", "execute/notification@2:14", "execute/notification@2:14/x", "execute/notification@6:10"]


def test_slash_in_names(spark):
    t = table(spark, {"a.md": [symbol("X", 5, (0, 0, 9, 0), [symbol("a/b", 6, (1, 0, 2, 0)), symbol("operator/", 6, (3, 0, 4, 0))])]})
    assert [r.name_path for r in t.orderBy("preorder").collect()] == ["X", "X/b", "X/X/operator/".rstrip("/")]


def test_go_methods_group_by_receiver(spark):
    t = table(spark, {"a.go": [symbol("(*T).M", 6, (0, 0, 1, 0)), symbol("U.M", 6, (2, 0, 3, 0)), symbol("(T).M", 6, (4, 0, 5, 0))]}, "go")
    assert [r.name_path for r in t.orderBy("preorder").collect()] == ["T/M@0:0", "U/M", "T/M@4:0"]


def test_bad_symbols_fail_the_call(spark):
    raw = spark.createDataFrame([("a", 0, "{}")], "file string, seq int, payload string")
    with pytest.raises(Exception, match="cannot be read"):
        tree.flatten(raw).collect()


def test_match_and_descendants(spark):
    t = table(spark, {"a.go": SERVICE})
    assert sorted(r.name_path for r in search.find(t, FindRequest("Service", depth=1)).collect()) == ["Service", "Service/GetSymbolsOverview"]
    assert sorted(r.name_path for r in search.find(t, FindRequest("Service", depth=2, exclude_kinds=(6,))).collect()) == ["Service", "Service/GetSymbolsOverview/request"]


def test_ambiguous_and_missing_targets(spark):
    t = table(spark, {"fixture.go": [symbol("Service", 5, (3, 0, 9, 0), [symbol("Register", 6, (4, 0, 5, 0))]), symbol("Server", 5, (13, 0, 19, 0), [symbol("Register", 6, (14, 0, 15, 0))])]})
    with pytest.raises(SafeError, match=r"multiple symbols match \"Register\".*Server/Register \(fixture.go:14\), Service/Register \(fixture.go:4\)"):
        search.resolve(t, "fixture.go", "Register")
    with pytest.raises(SafeError, match="no symbol matches"):
        search.resolve(t, "fixture.go", "Nothing")
    assert search.resolve(t, "fixture.go", "Server/Register").sel_line == 14


def greedy(nodes, line, char):
    """The walk that the join must equal."""
    for n in nodes:
        r = n["range"]
        s, e = (r["start"]["line"], r["start"]["character"]), (r["end"]["line"], r["end"]["character"])
        if s <= (line, char) < e:
            return greedy(n["children"], line, char) or n["name"]
    return None


def test_innermost_equals_a_greedy_walk(spark):
    rng = random.Random(5)

    def forest(depth):
        out = []
        for _ in range(rng.randint(0, 3)):
            a = rng.randint(0, 12)
            span = (a, rng.randint(0, 3), a + rng.randint(0, 8), rng.randint(0, 3))
            out.append(symbol(f"n{rng.random()}", 6, span, forest(depth - 1) if depth else []))
        return out

    files = {f"f{i}": forest(3) for i in range(60)}
    refs, want = [], {}
    for f, roots in files.items():
        for _ in range(8):
            line, char = rng.randint(0, 15), rng.randint(0, 3)
            want[len(refs)] = greedy(roots, line, char)
            refs.append((len(refs), f, line, char))
    t = table(spark, files)
    got = references.innermost(spark.createDataFrame(refs, "ref_id long, file string, line int, char int"), t)
    for r in got.collect():
        leaf = None if r.name_path is None else r.name_path.split("/")[-1]
        assert leaf == want[r.ref_id]


def test_representative_of_a_container(spark):
    rows = [(1, "f", 3, 9), (2, "f", 3, 9), (3, "f", 3, 17), (4, "f", 5, 3)]
    located = spark.createDataFrame([(*r, 12, "p", 0, 9) for r in rows], "ref_id long, file string, line int, char int, kind int, name_path string, first_line int, last_line int")
    for out in (references.grouped(located).first(), references.grouped_counts(located).first()):
        assert (out.ref_id, out.line, out.char, out.n_refs) == (1, 3, 9, 4)


def test_deep_trees_are_flattened(spark):
    span = '{"start":{"line":0,"character":0},"end":{"line":1,"character":0}}'
    payload = ""
    for i in range(300):
        payload = f'{{"kind":5,"name":"n{i}","range":{span},"selectionRange":{span},"children":[{payload}]}}'
    root = tree.decode(json.loads(payload), paths.plain_path)
    for _ in range(5000):  # beyond what JSON text can nest
        root = tree.Node(5, "x", root.range, root.sel, [root])
    tree.disambiguate([root])
    rows = list(tree._rows("f", [root]))
    assert len(rows) == 5300 and rows[0][5] == 5299 and rows[-1][3] == 5299
    raw = spark.createDataFrame([("f", 0, payload), ("g", 1, payload), ("g", 0, payload)], "file string, seq int, payload string")
    assert {r.file: r["count"] for r in tree.flatten(raw).groupBy("file").count().collect()} == {"f": 300, "g": 600}


def test_representative_is_first_by_lines_then_column(spark):
    rows = [(1, "f", 3, 2, 5), (2, "f", 3, 9, 4), (3, "f", 3, 8, 4), (4, "f", 7, 0, 7)]
    refs = spark.createDataFrame(rows, "ref_id long, file string, line int, char int, end_line int")
    located = refs.select("*", F.lit("a").alias("name_path"), F.lit(0).alias("first_line"), F.lit(9).alias("last_line"), F.lit(5).alias("kind"))
    one = references.grouped(located).first()
    assert (one.ref_id, one.n_refs) == (3, 4)


def test_a_referencing_file_without_content_fails(spark):
    refs = spark.createDataFrame([(1, "f", 0), (2, "gone", 0)], "ref_id long, file string, line int")
    files = spark.createDataFrame([("f", "text")], "file string, content string")
    assert references.with_evidence(refs.where("file = 'f'"), files).first().content == "text"
    with pytest.raises(Exception, match="cannot be read"):
        references.with_evidence(refs, files).collect()
