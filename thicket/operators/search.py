"""Overview and symbol search over the symbols table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.paths import Pattern, kind_filter, scope_filter
from thicket.functions.text import body_of
from thicket.model import FindRequest, SafeError, ambiguous, no_match
from thicket.operators.shape import top_ranked

FOUND = ["kind", "body", "info", "name_path", "file", "first_line", "last_line"]


def overview(symbols: DataFrame, depth: int = 0) -> DataFrame:
    """Symbols down to a depth, ``rank`` being their order in the file."""
    shown = symbols.where(F.col("depth") <= depth)
    rank = F.row_number().over(Window.partitionBy("file").orderBy("preorder"))
    return shown.select("file", "kind", "name_path", "first_line", "last_line", rank.alias("rank"))


def overview_sorted(symbols: DataFrame, depth: int = 0) -> DataFrame:
    """The same by position: for languages whose symbols are put together."""
    shown = symbols.where(F.col("depth") <= depth)
    rank = F.row_number().over(Window.partitionBy("file").orderBy("first_line", "last_line", "name_path", "kind", "preorder"))
    return shown.select("file", "kind", "name_path", "first_line", "last_line", rank.alias("rank"))


def matched_nodes(symbols: DataFrame, request: FindRequest) -> DataFrame:
    """Nodes that match, each with its descendants to the request's depth;
    kinds are filtered on both, and a node left out is still looked below. The
    first of equal (path, file, selected line) stays."""
    pattern = Pattern.parse(request.path, request.substring)
    scoped = symbols.where(scope_filter(F.col("file"), request.scope.path, request.scope.is_dir))
    kinds = kind_filter(F.col("kind"), request.include_kinds, request.exclude_kinds)
    roots = scoped.where(pattern.predicate() & kinds)
    if request.depth <= 0:
        found = roots.withColumn("_root", F.col("preorder"))
    else:
        top = roots.select(F.col("file").alias("_file"), F.col("preorder").alias("_root"), F.col("subtree_end").alias("_end"), F.col("depth").alias("_depth"))
        below = F.col("preorder").between(F.col("_root"), F.col("_end")) & (F.col("depth") - F.col("_depth") <= request.depth)
        found = scoped.where(kinds).join(top, (F.col("file") == F.col("_file")) & below).drop("_file", "_end", "_depth")
    first = Window.partitionBy("file", "name_path", "sel_line").orderBy("_root", "preorder")
    return found.withColumn("_n", F.row_number().over(first)).where(F.col("_n") == 1).drop("_n")


def find(symbols: DataFrame, request: FindRequest, files: DataFrame | None = None, hover: DataFrame | None = None) -> DataFrame:
    """Found symbols (``FOUND``) and ``preorder``, unordered. A body wins over
    info; either may be missing. Contents are read only if asked for."""
    nodes = matched_nodes(symbols, request.validate())
    body = info = F.lit(None).cast("string")
    if request.include_body and files is not None:
        nodes = nodes.join(files.select("file", F.col("content").alias("_content")), "file", "left")
        body = F.nullif(body_of(F.col("_content"), *(F.col(c) for c in ("start_line", "start_char", "end_line", "end_char"))), F.lit(""))
    elif request.include_info and hover is not None:
        told = hover.select("file", F.col("line").alias("sel_line"), F.col("character").alias("sel_char"), F.col("text").alias("_info"))
        nodes = nodes.join(told, ["file", "sel_line", "sel_char"], "left")
        info = F.nullif(F.trim("_info"), F.lit(""))
    return nodes.select("kind", body.alias("body"), info.alias("info"), "name_path", "file", "first_line", "last_line", "preorder")


def ranked(found: DataFrame, budget: int) -> DataFrame:
    """By file and position, in a total order: as many as ``budget`` bytes can hold."""
    order = ["file", "first_line", "last_line", "name_path", "kind", *(["preorder"] if "preorder" in found.columns else [])]
    return top_ranked(found, order, budget)


def ranked_in_file(found: DataFrame) -> DataFrame:
    """The rank within each file, which scales with the number of files."""
    order = ["first_line", "last_line", "name_path", "kind", *(["preorder"] if "preorder" in found.columns else [])]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("file").orderBy(*order)))


def resolve(symbols: DataFrame, file: str, path: str):
    """The one symbol of a file that a path names; if several match, the one
    that has exactly this path. The file's matches are few and are collected."""
    rows = symbols.where((F.col("file") == file) & Pattern.parse(path).predicate()).orderBy("preorder").collect()
    if len(rows) > 1:
        rows = [r for r in rows if r.name_path == path.strip().strip("/")] or rows
    if not rows:
        raise no_match(path)
    if len(rows) > 1:
        raise ambiguous(path, sorted(f"{r.name_path} ({r.file}:{r.first_line})" for r in rows))
    return rows[0]


def resolve_all(symbols: DataFrame, path: str) -> DataFrame:
    """For every file at once: how many symbols a path matches, and the sorted
    candidates where they are several."""
    own = symbols.where(Pattern.parse(path).predicate())
    shown = F.concat(F.col("name_path"), F.lit(" ("), F.col("file"), F.lit(":"), F.col("first_line"), F.lit(")"))
    grouped = own.groupBy("file").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(shown)).alias("c"))
    return grouped.select("file", "n", F.when(F.col("n") > 1, F.array_join("c", ", ")).alias("candidates"))


__all__ = ["FOUND", "SafeError", "find", "matched_nodes", "overview", "overview_sorted", "ranked", "ranked_in_file", "resolve", "resolve_all"]
