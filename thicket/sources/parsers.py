"""Sources that are parsed out of text: constants, re-exports, tables, JSON."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.model import KIND

# What a top-level constant and a re-export look like.
CONSTANT = r"^\s*const\s+([A-Za-z_\x{80}-\x{10ffff}][A-Za-z0-9_\x{80}-\x{10ffff}]*)(?![A-Za-z0-9_])"
REEXPORT = re.compile(r"""export(?:\s+type)?\s*\{([^}]*)\}\s*from\s*['"]([^'"]+)['"]\s*;""", re.S | re.A)
SPECIFIER = re.compile(r"\s*([$A-Za-z_][\w$]*)(?:\s+as\s+([$A-Za-z_][\w$]*))?\s*\Z", re.A)


def raw_symbols(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Fields of single raw symbols of either shape, from JSON text: ``name,
    kind, container, is_flat`` and the range. Children are left to ``flatten``."""
    v = F.parse_json(F.col(payload))
    get = lambda path, kind: F.variant_get(v, path, kind)
    flat = get("$.location", "variant").isNotNull()
    at = lambda path: F.when(flat, get(f"$.location.range.{path}", "int")).otherwise(get(f"$.range.{path}", "int"))
    sel = lambda path: F.when(flat, get(f"$.location.range.start.{path}", "int")).otherwise(get(f"$.selectionRange.start.{path}", "int"))
    return df.withColumns(
        {
            "name": get("$.name", "string"), "kind": get("$.kind", "int"), "is_flat": flat,
            "container": F.when(flat, F.trim(F.coalesce(get("$.containerName", "string"), F.lit("")))),
            "start_line": at("start.line"), "start_char": at("start.character"), "end_line": at("end.line"), "end_char": at("end.character"),
            "sel_line": sel("line"), "sel_char": sel("character"),
        }
    )


def clamped_depth(lines: DataFrame, delta: Column, by: list[str], order: str) -> DataFrame:
    """Adds ``depth_before``: the running sum of ``delta`` before each row,
    which is set to zero whenever it falls below. That equals S - min(0, the
    least running sum so far), so two window sums give it."""
    w = Window.partitionBy(*by).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    out = lines.withColumn("_s", F.sum(delta).over(so_far))
    out = out.withColumn("_d", F.col("_s") - F.least(F.lit(0), F.min("_s").over(so_far)))
    return out.withColumn("depth_before", F.coalesce(F.lag("_d").over(w), F.lit(0)).cast("int")).drop("_s", "_d")


def constants(files: DataFrame) -> DataFrame:
    """Constants of ``files`` (file, content) outside any brace: ``file, kind,
    name_path, first_line, last_line, declaration``."""
    text = F.split(F.replace("content", F.lit("\r\n"), F.lit("\n")), "\n", -1)
    lines = files.select("file", F.posexplode(text).alias("line", "text"))
    count = lambda c: F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))
    out = clamped_depth(lines, count("{") - count("}"), ["file"], "line").withColumn("name", F.regexp_extract("text", CONSTANT, 1))
    out = out.where((F.col("depth_before") == 0) & (F.col("name") != ""))
    return out.select("file", F.lit(KIND["Constant"]).alias("kind"), F.col("name").alias("name_path"), F.col("line").alias("first_line"), F.col("line").alias("last_line"), F.trim("text").alias("declaration"))


def _position(raw: bytes, offset: int) -> tuple[int, int]:
    """Line and byte column."""
    return raw.count(b"\n", 0, offset), offset - (raw.rfind(b"\n", 0, offset) + 1)


def parse_reexports(content: str) -> list[tuple]:
    """name, original, module, statement's start and end, name's start: all
    positions as line and byte column."""
    raw, out = content.encode(), []
    at = lambda i: _position(raw, len(content[:i].encode()))
    for m in REEXPORT.finditer(content):
        begin = m.start(1)
        for part in m[1].split(","):
            s = SPECIFIER.match(part)
            if s:
                group = 2 if s[2] else 1
                out.append((s[group], s[1], m[2], *at(m.start()), *at(m.end()), *at(begin + s.start(group))))
            begin += len(part) + 1
    return out


def reexports(files: DataFrame) -> DataFrame:
    """Match offsets are needed, which Spark's patterns do not give."""
    names = ["name", "original", "module", "start_line", "start_char", "end_line", "end_char", "line", "char"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, *r) for f, c in zip(pdf["file"], pdf["content"]) for r in parse_reexports(c or "")]
            yield pd.DataFrame(rows, columns=["file", *names])

    schema = "file string, name string, original string, module string, " + ", ".join(f"{c} int" for c in names[3:])
    return files.where(F.contains("content", F.lit("export"))).select("file", "content").mapInPandas(run, schema)


def default_export(files: DataFrame) -> DataFrame:
    """Position of the first ``export default`` of each file that has one."""
    at = F.instr("content", "export default")
    head = F.substring(F.col("content"), F.lit(1), at - 1)
    line = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
    return files.where(at > 0).select("file", line.cast("int").alias("line"), F.octet_length(F.substring_index(head, "\n", -1)).alias("char"))


def reference_table(lines: DataFrame, text: str = "value") -> DataFrame:
    """Rows of a table drawn with pipes (path, line from 1, ...) to distinct
    ``file, line``. The heading goes; a line that is no number is an error."""
    parts = F.transform(F.split(F.trim(text), r"\|", -1), lambda x: F.trim(x))
    rows = lines.where(F.trim(text).startswith("|")).select(parts.alias("p")).where((F.size("p") >= 6) & (F.get("p", F.lit(2)) != "LN"))
    number = F.when(F.get("p", F.lit(2)) != "LN", F.get("p", F.lit(2)))  # a filter pushed down might else see the heading
    return rows.select(F.get("p", F.lit(1)).alias("file"), (number.cast("int") - 1).alias("line")).distinct()


def compile_commands(text: Column, root: str) -> Column:
    """Compile commands with relative folders made absolute, all else as it is."""
    commands = F.variant_get(F.parse_json(text), "$", "array<map<string,variant>>")

    def fix(c: Column) -> Column:
        own = F.variant_get(c["directory"], "$", "string")
        whole = F.when(own.startswith("/"), own).otherwise(F.concat_ws("/", F.lit(root), F.nullif(own, F.lit(""))))
        return F.map_concat(F.map_filter(c, lambda k, _: k != "directory"), F.create_map(F.lit("directory"), whole.cast("variant")))

    return F.to_json(F.transform(commands, fix))


def compilation_database(root: str) -> str | None:
    """The file that says how to compile: commands, else flags, else none."""
    for name in ("compile_commands.json", "compile_flags.txt"):
        if os.path.isfile(os.path.join(root, name)):
            return name
    return None


def config_fragments(text: str) -> list[dict]:
    """Documents of a small configuration file: ``If`` (PathMatch,
    PathExclude) and ``CompileFlags`` (CompilationDatabase). Only the block
    style that these use is read: keys, scalars and lists of scalars."""
    out = []
    for doc in re.split(r"(?m)^---\s*$", text):
        found: dict = {}
        section = key = None
        for line in doc.splitlines():
            body = line.split(" #")[0].rstrip()
            if not body.strip() or body.lstrip().startswith("#"):
                continue
            item = body.strip()
            if not line[0].isspace():
                section, key = item.rstrip(":"), None
                found.setdefault(section, {})
            elif item.startswith("- ") and key is not None:
                found[section].setdefault(key, []).append(_scalar(item[2:]))
            elif section is not None:
                key, _, value = (x.strip() for x in item.partition(":"))
                if value.startswith("["):
                    found[section][key] = [_scalar(x) for x in value.strip("[]").split(",") if x.strip()]
                else:
                    found[section][key] = [_scalar(value)] if value else []
        if found:
            out.append(found)
    return out


def _scalar(text: str) -> str:
    text = text.strip()
    return json.loads(text) if text.startswith('"') else text.strip("'")


def fragment_applies(fragment: dict, file: str) -> bool:
    """Any PathMatch must match the whole path, and no PathExclude. A pattern
    that cannot be compiled raises ``re.error``."""
    when = fragment.get("If", {})
    match, exclude = when.get("PathMatch", []), when.get("PathExclude", [])
    return (not match or any(re.fullmatch(p, file) for p in match)) and not any(re.fullmatch(p, file) for p in exclude)


def fragment_predicate(fragment: dict, file: Column) -> Column:
    """``fragment_applies`` over a column. Patterns are checked first."""
    when = fragment.get("If", {})
    any_of = lambda patterns: F.coalesce(*[F.when(file.rlike(f"\\A(?:{re.compile(p).pattern})\\z"), True) for p in patterns], F.lit(False))
    match, exclude = when.get("PathMatch", []), when.get("PathExclude", [])
    return (any_of(match) if match else F.lit(True)) & ~(any_of(exclude) if exclude else F.lit(False))


def trimmed_entries(values: Column) -> Column:
    """Trimmed, without the empty ones."""
    return F.filter(F.transform(values, lambda x: F.trim(x, F.lit(" \t\r\n"))), lambda x: x != "")


def key_values(entries: Column) -> Column:
    """``KEY=VALUE`` entries as a map; of equal keys the last one counts. An
    entry without a sign or with an empty key is an error."""
    bad = lambda e: ~F.contains(e, F.lit("=")) | (F.trim(F.substring_index(e, "=", 1)) == "")
    key = lambda e: F.trim(F.substring_index(e, "=", 1))
    pair = lambda e, i: F.struct(key(e).alias("k"), F.substring(e, F.instr(e, "=") + 1, F.length(e)).alias("v"), i.alias("i"))
    pairs = F.transform(entries, pair)
    last = F.filter(pairs, lambda p: ~F.exists(pairs, lambda q: (q["k"] == p["k"]) & (q["i"] > p["i"])))
    fine = F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], p["v"])))
    return F.when(F.exists(entries, bad), F.raise_error(F.lit("entries must use KEY=VALUE format with a non-empty key")).cast("map<string,string>")).otherwise(fine)
