"""References to their containers, and one representative for each.

References, symbols and files all grow with the workspace, so they are joined
by sorting both sides: the hints keep a side whose size Spark underestimates
from being broadcast, which the driver's memory bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.paths import kind_filter, position_in, stem
from thicket.functions.text import snippet
from thicket.model import FILE_KIND

#: Beyond any sibling number: a node sorts after what is below it.
_LAST = 2**31 - 1


def innermost(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Every reference (``ref_id, file, line, char``) with the symbol that a
    greedy walk ends in: at each level the first sibling that holds the point,
    never another. A node counts only if all its ancestors hold the point too.
    Null where no symbol does. An equi-join on the file, with the interval as
    its residual condition."""
    line, char = F.col("line"), F.col("char")
    span = ["start_line", "start_char", "end_line", "end_char"]
    sym = symbols.select(
        F.col("file").alias("_file"), "node_id", "kind", "name_path", "first_line", "last_line", F.col("ord_path").alias("_path"), F.col("anc").alias("_anc"), *(F.col(c).alias(f"_{c}") for c in span)
    )
    holds = position_in(line, char, *(F.col(f"_{c}") for c in span))
    chain = F.forall("_anc", lambda r: position_in(line, char, r["sl"], r["sc"], r["el"], r["ec"]))
    found = refs.select("ref_id", "file", "line", "char").join(sym.hint("merge"), (F.col("file") == F.col("_file")) & holds & chain).select(
        "ref_id", "node_id", "kind", "name_path", "first_line", "last_line", F.array_append("_path", F.lit(_LAST)).alias("_order")
    )
    best = Window.partitionBy("ref_id").orderBy("_order")
    one = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") == 1).drop("_n", "_order")
    return refs.join(one.hint("merge"), "ref_id", "left")


def with_file_fallback(located: DataFrame, files: DataFrame) -> DataFrame:
    """A reference in no symbol belongs to its file: its name, all its lines.
    ``files`` has ``file`` and ``n_lines``."""
    out = located.join(files.select("file", "n_lines").hint("merge"), "file", "left")
    lost = F.col("node_id").isNull()
    return out.withColumns(
        {
            "kind": F.when(lost, FILE_KIND).otherwise(F.col("kind")),
            "name_path": F.when(lost, stem(F.col("file"))).otherwise(F.col("name_path")),
            "first_line": F.when(lost, 0).otherwise(F.col("first_line")),
            "last_line": F.when(lost, F.greatest(F.coalesce("n_lines", F.lit(1)) - 1, F.lit(0))).otherwise(F.col("last_line")),
        }
    ).drop("n_lines")


def keep_kinds(located: DataFrame, include: tuple[int, ...] = (), exclude: tuple[int, ...] = ()) -> DataFrame:
    """After the innermost container is known: a reference whose container is
    filtered out goes; it does not climb to the parent."""
    return located.where(F.col("kind").isNotNull() & kind_filter(F.col("kind"), include, exclude))


def with_evidence(located: DataFrame, contents: DataFrame, end_line: Column | None = None) -> DataFrame:
    """The lines around each reference. ``contents``: file, content. A file
    that has none fails the call, as lines outside it do."""
    out = located.join(contents.select("file", F.col("content").alias("_text")).hint("merge"), "file", "left")
    lost = F.raise_error(F.concat(F.lit("a referencing file cannot be read: "), "file")).cast("string")
    out = out.withColumn("_text", F.when(F.col("_text").isNull(), lost).otherwise(F.col("_text")))
    a, b, text = snippet(F.col("_text"), F.col("line"), F.col("line") if end_line is None else end_line)
    return out.withColumns({"content_start": a, "content_end": b, "content": text}).drop("_text")


def grouped(located: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """One row a container (path, file, lines): its first reference by line,
    last line and column, ties by ``ref_id``, and how many there were. Partial
    aggregates, so a container of very many references is combined before it is
    sent; what ``extra`` names travels only with a task's first one."""
    key = ["name_path", "file", "first_line", "last_line"]
    extra = extra or []
    end = F.coalesce("end_line", "line") if "end_line" in located.columns else F.col("line")
    order = F.struct("line", end.alias("end"), "char", "ref_id")
    head = F.min_by(F.struct("kind", "line", "char", "ref_id", *extra), order).alias("h")
    found = located.groupBy(*key).agg(head, F.count("*").alias("n_refs"))
    return found.select(*key, *(F.col(f"h.{c}").alias(c) for c in ["kind", "line", "char", "ref_id", *extra]), "n_refs")


def grouped_counts(located: DataFrame) -> DataFrame:
    """``grouped`` without snippets."""
    return grouped(located)


def by_file(rows: DataFrame) -> DataFrame:
    """``rank``: the order within each file."""
    order = Window.partitionBy("file").orderBy("first_line", "last_line", "name_path", "kind")
    return rows.withColumn("rank", F.row_number().over(order))


def smallest_by_lines(points: DataFrame, symbols: DataFrame, include: tuple[int, ...] = (), exclude: tuple[int, ...] = ()) -> DataFrame:
    """For points (``ref_id, file, line``): the narrowest symbol whose lines
    hold it, of the kinds asked for (filtered before, unlike ``keep_kinds``);
    ties by the smaller start, then order."""
    sym = symbols.where(kind_filter(F.col("kind"), include, exclude)).select(F.col("file").alias("_f"), "kind", "name_path", "first_line", "last_line", "preorder")
    held = points.join(sym.hint("merge"), (F.col("file") == F.col("_f")) & F.col("line").between(F.col("first_line"), F.col("last_line"))).drop("_f")
    best = Window.partitionBy("ref_id").orderBy(F.col("last_line") - F.col("first_line"), "first_line", "preorder")
    return held.withColumn("_n", F.row_number().over(best)).where(F.col("_n") == 1).drop("_n", "preorder")


def smallest_in_overview(points: DataFrame, symbols: DataFrame, depth: int = 32) -> DataFrame:
    """The same for definitions: no kinds, a bounded depth, and the first of
    equal widths in order."""
    sym = symbols.where(F.col("depth") <= depth).select(F.col("file").alias("_f"), "kind", "name_path", "first_line", "last_line", "preorder")
    held = points.join(sym.hint("merge"), (F.col("file") == F.col("_f")) & F.col("line").between(F.col("first_line"), F.col("last_line"))).drop("_f")
    best = Window.partitionBy("ref_id").orderBy(F.col("last_line") - F.col("first_line"), "preorder")
    return held.withColumn("_n", F.row_number().over(best)).where(F.col("_n") == 1).drop("_n", "preorder")


def look_unfinished(found: DataFrame, targets: DataFrame, workflow: DataFrame) -> DataFrame:
    """A data-quality check: references are suspect where none lies outside the
    target's own file although its workflow has other files. ``found``: target_file,
    file; ``targets``: target_file; ``workflow``: target_file, file. Adds
    ``suspect`` to the targets."""
    elsewhere = lambda df: df.where(F.col("file") != F.col("target_file")).select("target_file").distinct()
    other = elsewhere(workflow).withColumn("_more", F.lit(True))
    seen = elsewhere(found).withColumn("_seen", F.lit(True))
    out = targets.join(other, "target_file", "left").join(seen, "target_file", "left")
    return out.withColumn("suspect", F.col("_more").isNotNull() & F.col("_seen").isNull()).drop("_more", "_seen")
