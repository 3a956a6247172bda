"""Raw symbols to the flat symbols table.

A file's symbols come as JSON, one row a root in order (``seq``), in either of
two shapes: nested (``children``) or flat (``location``, ``containerName``). A
file is flattened in one go, in pre-order, as its paths depend on its siblings:
equal names under one parent get ``@line:char``, and what is below them is
renamed as well. Other trees (of tables) are completed by ``complete``.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.paths import base_of, go_path, last_line, plain_path
from thicket.model import SYMBOL_SCHEMA, SafeError

PATH_BUILDERS: dict[str, Callable[[str, str], str]] = {"plain": plain_path, "go": go_path}
_FLAT = "file string, node_id long, parent_id long, depth int, preorder long, subtree_end long, ord_path array<int>, kind int, components array<string>, start_line int, start_char int, end_line int, end_char int, sel_line int, sel_char int"


class Node:
    __slots__ = ("kind", "path", "range", "sel", "children")

    def __init__(self, kind: int, path: str, span: dict, sel: tuple[int, int], children: list[Node]):
        self.kind, self.path, self.range, self.sel, self.children = kind, path, span, sel, children


def decode(payload: dict, build: Callable[[str, str], str], parent: str = "") -> Node:
    """One raw symbol, of either shape, and all below it (without recursion:
    trees may be deep)."""
    roots: list[Node] = []
    todo = [(payload, parent, roots)]
    while todo:
        raw, above, siblings = todo.pop()
        if "location" in raw:
            span = raw["location"]["range"]
            path = build((raw.get("containerName") or "").strip(), raw["name"])
            siblings.append(Node(raw["kind"], path, span, (span["start"]["line"], span["start"]["character"]), []))
            continue
        path, sel = build(above, raw["name"]), raw["selectionRange"]["start"]
        node = Node(raw["kind"], path, raw["range"], (sel["line"], sel["character"]), [])
        siblings.append(node)
        todo += [(c, path, node.children) for c in reversed(raw.get("children") or [])]
    return roots[0]


def split_path(path: str) -> tuple[str, str]:
    """Parent and leaf by the last slash. A path that ends in one is all leaf;
    a slash at the very start leaves no parent."""
    at = path.rfind("/")
    return path[:at] if at > 0 else "", path[at + 1 :] if 0 <= at < len(path) - 1 else path


def disambiguate(nodes: list[Node], parent: str = "") -> None:
    """Roots group under the parent that their own path names."""
    todo = [(nodes, parent)]
    while todo:
        siblings, above = todo.pop()
        named = []
        for n in siblings:
            own_parent, leaf = split_path(n.path)
            named.append((n, above or own_parent, leaf))
        seen = Counter(plain_path(p, leaf) for _, p, leaf in named)
        for n, p, leaf in named:
            mark = f"@{n.sel[0]}:{n.sel[1]}" if seen[plain_path(p, leaf)] > 1 else ""
            n.path = plain_path(p, leaf + mark)
            todo.append((n.children, n.path))


def _rows(file: str, roots: list[Node]) -> Iterator[list]:
    """In pre-order; a node's last column but one of its interval is set once
    what is below it has been counted."""
    out: list[list] = []
    todo: list[tuple] = [(n, None, 0, [i]) for i, n in reversed(list(enumerate(roots)))]
    while todo:
        n, parent, depth, where = todo.pop()
        me = len(out)
        s, e = n.range["start"], n.range["end"]
        out.append([file, me, parent, depth, me, me, where, n.kind, n.path.strip("/").split("/"), s["line"], s["character"], e["line"], e["character"], *n.sel])
        todo += [(c, me, depth + 1, [*where, i]) for i, c in reversed(list(enumerate(n.children)))]
    for row in reversed(out):
        if row[2] is not None:
            out[row[2]][5] = max(out[row[2]][5], row[5])
    yield from out


def _flat_file(file: str, payloads: list[str], build: str) -> list[list]:
    try:
        roots = [decode(json.loads(p), PATH_BUILDERS[build]) for p in payloads]
    except (KeyError, TypeError, ValueError, RecursionError) as e:
        raise SafeError(f"symbols of {file} cannot be read", e) from e
    disambiguate(roots)
    return list(_rows(file, roots))


def flatten(raw: DataFrame, build: str = "plain") -> DataFrame:
    """``raw`` (file, seq, payload as JSON text) to the symbols table. Rows come
    sorted by file, so a task holds one file's at a time."""
    names = [c.split(" ")[0] for c in _FLAT.split(", ")]

    def frame(rows: list[list]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"parent_id": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, rows = None, [], []
        for pdf in batches:
            for file, payload in zip(pdf["file"], pdf["payload"]):
                if file != now:
                    rows += _flat_file(now, held, build) if held else []
                    now, held = file, []
                    if len(rows) > 20_000:
                        yield frame(rows)
                        rows = []
                held.append(payload)
        rows += _flat_file(now, held, build) if held else []
        yield frame(rows)

    dealt = raw.select("file", "seq", "payload").repartition("file").sortWithinPartitions("file", "seq")
    return with_derived(dealt.select("file", "payload").mapInPandas(run, _FLAT))


def with_ancestors(nodes: DataFrame) -> DataFrame:
    """Adds ``anc``: ranges of every node's ancestors, from the root. An
    ancestor is a node of the file whose pre-order interval holds this one.
    Every node is on both sides, and Spark takes generated rows for few: the
    hint keeps them from being broadcast."""
    up = nodes.select(
        F.col("file").alias("_f"), F.col("preorder").alias("_p"), F.col("subtree_end").alias("_e"),
        F.struct(F.col("start_line").alias("sl"), F.col("start_char").alias("sc"), F.col("end_line").alias("el"), F.col("end_char").alias("ec")).alias("_r"),
    )
    inside = (F.col("file") == F.col("_f")) & (F.col("preorder") > F.col("_p")) & (F.col("preorder") <= F.col("_e"))
    found = nodes.select("file", "preorder").join(up.hint("merge"), inside).groupBy("file", "preorder").agg(F.array_sort(F.collect_list(F.struct("_p", "_r"))).alias("_a"))
    none = F.array().cast("array<struct<sl:int,sc:int,el:int,ec:int>>")
    return nodes.join(found.hint("merge"), ["file", "preorder"], "left").withColumn("anc", F.coalesce(F.transform("_a", lambda x: x["_r"]), none)).drop("_a")


def with_names(nodes: DataFrame) -> DataFrame:
    """Adds what follows from ``components`` and ranges."""
    return nodes.withColumns(
        {
            "name_path": F.array_join("components", "/"),
            "bases": F.transform("components", base_of),
            "leaf_base": base_of(F.element_at("components", -1)),
            "first_line": F.col("start_line"),
            "last_line": last_line(F.col("start_line"), F.col("end_line"), F.col("end_char")),
        }
    )


def with_derived(nodes: DataFrame) -> DataFrame:
    names = [c.split(" ")[0] for c in SYMBOL_SCHEMA.split(", ")]
    return with_ancestors(with_names(nodes)).select(*names)


def mark_duplicates(name: Column, siblings: list[Column], line: Column, char: Column) -> Column:
    """A component: the name, with its position if a sibling has it too."""
    twin = F.count("*").over(Window.partitionBy(*siblings, name)) > 1
    return F.when(twin, F.concat(name, F.lit("@"), line, F.lit(":"), char)).otherwise(name)
