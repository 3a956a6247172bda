"""Unions of results: merging, filling gaps, appending what is missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.functions.paths import clean_path

KEY = ["name_path", "file", "first_line", "last_line"]


def merge_found(parts: list[DataFrame]) -> DataFrame:
    """Union in the order given (``adapter_rank``): of rows with one key the
    first stays, and later ones fill an empty body or info."""
    tagged = [p.withColumn("_rank", F.lit(i)) for i, p in enumerate(parts)]
    every = tagged[0]
    for p in tagged[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    filled = lambda c: F.min(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.struct("_rank", c))).getField(c)
    return every.groupBy(*KEY).agg(F.min(F.struct("_rank", "kind")).getField("kind").alias("kind"), filled("body").alias("body"), filled("info").alias("info"))


def append_missing(base: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``more`` whose key is not in ``base``, added to it."""
    fresh = more.dropDuplicates(key).join(base.select(*key), key, "left_anti")
    return base.unionByName(fresh, allowMissingColumns=True)


def append_constants(base: DataFrame, constants: DataFrame) -> DataFrame:
    return append_missing(base, constants, ["file", "name_path", "first_line", "last_line"])


def append_aliases(base: DataFrame, aliases: DataFrame) -> DataFrame:
    return append_missing(base, aliases, ["name_path", "file", "first_line"])


def append_property_refs(base: DataFrame, more: DataFrame, declared_file: str, declared_line: int) -> DataFrame:
    """By file and path alone; the declaration itself is not a reference."""
    other = more.where(~((F.col("file") == declared_file) & (F.col("line") == declared_line)))
    return append_missing(base, other, ["file", "name_path"])


def first_non_empty(*attempts: Callable[[], DataFrame]) -> DataFrame:
    """Each attempt is made only if those before found nothing."""
    out = None
    for attempt in attempts:
        out = attempt()
        if not out.isEmpty():
            break
    return out


def resolve_aliases(aliases: DataFrame, definitions: DataFrame, symbols: DataFrame, files: DataFrame, extensions: list[str]) -> DataFrame:
    """Re-exported names (``file, name, original, module, line, char``) to the
    symbols behind them. The definition's file and smallest symbol come first;
    if it lies in the alias's own file or is missing, a relative module is
    tried with each extension in order and looked up by its exact path."""
    from thicket.operators.references import smallest_in_overview

    a = aliases.withColumn("ref_id", F.xxhash64("file", "name", "line", "char"))
    first = definitions.groupBy("file", "line", "character").agg(F.min(F.struct("seq", "def_file", "def_line")).alias("d"))
    first = first.select("file", F.col("line"), F.col("character").alias("char"), "d.def_file", "d.def_line")
    at = a.join(first, ["file", "line", "char"], "left").where(F.col("def_file") != F.col("file"))
    by_def = smallest_in_overview(at.select("ref_id", F.col("def_file").alias("file"), F.col("def_line").alias("line")), symbols)
    by_def = by_def.select("ref_id", F.col("file").alias("f1"), F.col("name_path").alias("p1"), F.col("kind").alias("k1"))

    relative = a.where(F.col("module").startswith("./") | F.col("module").startswith("../"))
    folder = F.regexp_replace(F.col("file"), r"[^/]*$", "")
    joined = clean_path(F.concat(folder, F.col("module")))
    ranks = F.explode(F.array(*[F.struct(F.lit(i).alias("r"), F.lit(e).alias("e")) for i, e in enumerate(["", *extensions])]))
    tries = relative.select("ref_id", "original", joined.alias("m"), ranks.alias("x")).select("ref_id", "original", "x.r", F.concat("m", "x.e").alias("file"))
    source = tries.join(files.select("file"), "file").groupBy("ref_id", "original").agg(F.min(F.struct("r", "file")).getField("file").alias("f2"))
    by_path = source.join(symbols.select(F.col("file").alias("f2"), F.col("name_path").alias("original"), F.col("kind").alias("k2")), ["f2", "original"])
    by_path = by_path.groupBy("ref_id").agg(F.min(F.struct("f2", "original", "k2")).alias("s")).select("ref_id", "s.f2", F.col("s.original").alias("p2"), "s.k2")

    out = a.join(by_def, "ref_id", "left").join(by_path, "ref_id", "left")
    return out.select(
        *aliases.columns, F.coalesce("f1", "f2").alias("source_file"), F.coalesce("p1", "p2").alias("source_path"), F.coalesce("k1", "k2").alias("source_kind")
    )


def rewrite_target(targets: DataFrame, resolved: DataFrame) -> DataFrame:
    """A reference search on an alias looks for what is behind it."""
    first = resolved.where(F.col("source_file").isNotNull()).groupBy("file", F.col("name").alias("path")).agg(F.min(F.struct("line", "char", "source_file", "source_path")).alias("s"))
    out = targets.join(first, ["file", "path"], "left")
    return out.select(F.coalesce("s.source_file", "file").alias("file"), F.coalesce("s.source_path", "path").alias("path"))
