import json
import random

import pytest
from pyspark.sql import functions as F

from thicket.functions import text as t
from thicket.model import SafeError
from thicket.operators import shape


def utf16_slice(line, a, b):
    """Columns in UTF-16 units; one inside a pair is the pair's start."""
    at, edges = 0, []
    for i, c in enumerate(line):
        edges += [i] * (2 if ord(c) > 0xFFFF else 1)
        at += 2 if ord(c) > 0xFFFF else 1
    edges.append(len(line))
    i, j = (edges[min(max(x, 0), len(edges) - 1)] for x in (a, b))
    return line[i : max(i, j)]


def test_utf16_slices(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice("aé😀中 ") for _ in range(rng.randint(0, 8))), rng.randint(0, 10), rng.randint(0, 12)) for _ in range(400)]
    df = spark.createDataFrame(rows, "s string, a int, b int")
    for r in df.select("s", "a", "b", t.slice_utf16(F.col("s"), F.col("a"), F.col("b")).alias("x"), t.utf16_width(F.col("s")).alias("w")).collect():
        assert r.x == utf16_slice(r.s, r.a, r.b)
        assert r.w == len(r.s.encode("utf-16-le")) // 2


def test_bodies_and_snippets(spark):
    content = "package fixture\n\nfunc Use() {\n\tMakeBucket()\n}\n"
    df = spark.createDataFrame([(content,)], "c string")
    a, b, s = t.snippet(F.col("c"), F.lit(3), F.lit(3))
    r = df.select(a.alias("a"), b.alias("b"), s.alias("s"), t.body_of(F.col("c"), F.lit(2), F.lit(5), F.lit(4), F.lit(1)).alias("body")).first()
    assert (r.a, r.b, r.s) == (2, 4, "func Use() {\n\tMakeBucket()\n}")
    assert r.body == "Use() {\n\tMakeBucket()\n}"
    _, _, bad = t.snippet(F.col("c"), F.lit(30), F.lit(30))
    with pytest.raises(Exception, match="outside its file"):
        df.select(bad).collect()


def test_info_fallback(spark):
    df = spark.createDataFrame([("a\n  function b() {\n", "Could not find source with x"), ("a\n  function b() {\n", "doc"), ("a\n", None)], "c string, i string")
    out = [r.x for r in df.select(t.info_or_declaration(F.col("i"), F.col("c"), F.lit(0), F.lit(1), F.lit("b")).alias("x")).collect()]
    assert out == ["function b() {", "doc", "a"]


def test_offsets(spark):
    line, char = t.offset_position(F.lit("é\nab"), F.lit(4))
    r = spark.range(1).select(line.alias("l"), char.alias("c")).first()
    assert (r.l, r.c) == (1, 1)


def go_json(value):
    text = json.dumps(value, separators=(",", ":"), ensure_ascii=False)
    for c in "<>&\u2028\u2029":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return len(text.encode())


def found(spark, n, file=lambda i: f"f{i}.go"):
    rows = [(i + 1, 6, "a < b" if i % 2 else None, None, f"p{i}é", file(i), i, i + 2) for i in range(n)]
    return spark.createDataFrame(rows, "rank int, kind int, body string, info string, name_path string, file string, first_line int, last_line int")


def as_items(rows):
    return [{k: v for k, v in (("kind", r.kind), ("body", r.body), ("path", r.name_path), ("file", r.file), ("range", f"{r.first_line}-{r.last_line}")) if v} for r in rows]


def test_budget_is_the_longest_prefix(spark):
    df = found(spark, 12)
    rows = df.orderBy("rank").collect()
    for budget in (60, 150, 333, 700, 10_000):
        k = max([k for k in range(13) if go_json({"symbols": as_items(rows[:k])}) <= budget], default=0)
        if k == 0:
            with pytest.raises(SafeError, match="too large"):
                shape.limited_found(df, budget)
            continue
        kept, percent = shape.limited_found(df, budget)
        assert kept.count() == k
        assert percent == (None if k == 12 else max(1, min(99, 100 * k // 12)))
    with pytest.raises(SafeError):
        shape.limited_found(df, 1)
    assert shape.limited_found(df, 0)[0].count() == 12


def test_json_shapes(spark):
    two = found(spark, 2)
    assert json.loads(shape.found_json(two, 50).first().json) == {"symbols": as_items(two.orderBy("rank").collect()), "returned_percent": 50}
    empty = two.where("false").withColumns({"content_start": F.lit(0), "content_end": F.lit(0), "content": F.lit("")})
    assert shape.references_json(empty).first().json == '{"files":[]}'
    assert shape.references_json(empty, incomplete=True).first().json == '{"files":[],"incomplete":true}'
    kinds = spark.createDataFrame([(1, 6, "a", 14, 14), (2, 12, "b", 34, 39), (3, 6, "c", 29, 31)], "rank int, kind int, name_path string, first_line int, last_line int")
    assert json.loads(shape.overview_json(shape.overview_items(kinds)).first().json) == {"groups": [{"kind": 6, "symbols": [{"path": "a", "range": "14"}, {"path": "c", "range": "29-31"}]}, {"kind": 12, "symbols": [{"path": "b", "range": "34-39"}]}]}


def test_percent(spark):
    r = spark.range(1).select(*[shape.returned_percent(F.lit(a), F.lit(b)).alias(n) for n, a, b in (("x", 1, 200), ("y", 99, 99), ("z", 0, 9))]).first()
    assert (r.x, r.y, r.z) == (1, 99, 0)


def test_outline_budget_cuts_groups_in_order(spark):
    rows = [(i + 1, [6, 12, 5][i % 3], f"n{i}", i, i + i % 2) for i in range(9)]
    items = shape.overview_items(spark.createDataFrame(rows, "rank int, kind int, name_path string, first_line int, last_line int"))
    order = [r for k in (6, 12, 5) for r in rows if r[1] == k]
    for budget in (75, 120, 200, 5000):
        best = 0
        for n in range(10):
            groups = []
            for _, kind, path, a, b in order[:n]:
                if not groups or groups[-1]["kind"] != kind:
                    groups.append({"kind": kind, "symbols": []})
                groups[-1]["symbols"].append({"path": path, "range": str(a) if a == b else f"{a}-{b}"})
            if go_json({"groups": groups}) <= budget:
                best, want = n, groups
        kept, percent = shape.limited_overview(items, budget)
        assert json.loads(shape.overview_json(kept, percent).first().json) == {"groups": want} | ({"returned_percent": 100 * best // 9} if best < 9 else {})
