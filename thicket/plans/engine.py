"""The three queries, from a validated request to rows or JSON.

An ``Engine`` holds the tables of one workspace. Requests are compiled on the
driver into one lazy plan over them; only results, which a byte budget bounds,
are collected.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions.paths import alias_pattern, constant_pattern, extension, kind_filter, last_line, property_target, rust_export, scope_filter, strip_first_mark
from thicket.functions.text import body_of, info_or_declaration, lines_of, physical_line
from thicket.model import KIND, FindRequest, OverviewRequest, ReferencesRequest, SafeError, Scope, internal_error, unsupported_extension
from thicket.operators import combine, references, search, shape
from thicket.plans.adapters import ADAPTERS, Adapter
from thicket.sources.workspace import adapter_of_file, register

BUDGET_BYTES = 32_768
TIMEOUT_SECONDS = 360
PROPERTY_DEPTH = 8  # of symbols that a property's use may be in
# Public texts of a request that takes too long.
TIMED_OUT = "tool execution timed out after {}"
WARMING_UP = "request timed out, the LSP server may still be warming up"


def duration(seconds: int) -> str:
    """``6m0s``: hours and minutes only where there are any."""
    h, m, s = seconds // 3600, seconds // 60 % 60, seconds % 60
    return f"{h}h{m}m{s}s" if h else f"{m}m{s}s" if m else f"{s}s"


@contextmanager
def time_limit(spark: SparkSession, seconds: float, tag: str = "thicket-request"):
    """Cancels the jobs started inside once the time is up, and those that come
    after as well; what has not ended by then has timed out."""
    over, late, context = threading.Event(), threading.Event(), spark.sparkContext

    def watch() -> None:
        wait = seconds
        while not over.wait(wait):
            late.set()
            context.cancelJobsWithTag(tag)  # a session's own tags are known to their thread alone
            wait = 0.2

    timed_out = TIMED_OUT.format(duration(int(seconds)))
    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        yield
    except Exception as e:
        if late.is_set():
            raise SafeError(timed_out, e) from e
        raise
    finally:
        over.set()
        watcher.join()
        context.removeJobTag(tag)
    if late.is_set():
        raise SafeError(timed_out)


def public(run: Callable):
    """An engine's request within its time. Safe errors pass, an inner deadline
    is told as such, and any other becomes an internal error."""

    def wrapped(engine, *args, **kwargs):
        try:
            with time_limit(engine.symbols.sparkSession, engine.timeout, f"thicket-request-{uuid.uuid4().hex}"):
                return run(engine, *args, **kwargs)
        except (SafeError, ValueError):
            raise
        except TimeoutError as e:
            raise SafeError(WARMING_UP, e) from e
        except Exception as e:
            raise internal_error(e) from e

    return wrapped


@dataclass
class Engine:
    """``symbols`` is the flat table; ``files`` has file and content;
    ``raw_references`` has target_file, target_line, target_char, ref_file,
    line, char, end_line, seq; ``property_references`` has declared_file,
    property, file and line, as ``parsers.reference_table`` reads them. The
    others may be missing."""

    symbols: DataFrame
    files: DataFrame | None = None
    raw_references: DataFrame | None = None
    hover: DataFrame | None = None
    constants: DataFrame | None = None
    aliases: DataFrame | None = None
    property_references: DataFrame | None = None
    incomplete: bool = False
    registry: dict[str, str] = field(default_factory=lambda: register({a.name: a.extensions for a in ADAPTERS.values()}))
    budget: int = BUDGET_BYTES
    timeout: float = TIMEOUT_SECONDS

    def _adapter(self, file: str) -> Adapter:
        return ADAPTERS[adapter_of_file(file, self.registry)]

    def _of(self, adapter: Adapter) -> DataFrame:
        return self.symbols.where(extension(F.col("file")).isin([e.lower() for e in adapter.extensions]))

    # -- overview -----------------------------------------------------------

    def overview(self, request: OverviewRequest) -> DataFrame:
        request.validate()
        adapter = self._adapter(request.file)
        own = self.symbols.where(F.col("file") == request.file)
        if adapter.constants and self.constants is not None:
            own = combine.append_constants(own, self.constants.where(F.col("file") == request.file).drop("declaration").withColumn("depth", F.lit(0)))
        if adapter.aliases and self.aliases is not None:
            own = combine.append_aliases(own, self._alias_rows(F.col("file") == request.file).withColumn("depth", F.lit(0)))
        arrange = search.overview_sorted if adapter.sort_overview or (adapter.aliases and self.aliases is not None) else search.overview
        out = arrange(own, request.depth)
        return out.withColumn("name_path", rust_export(F.col("name_path"))) if adapter.export_rust else out

    def _alias_rows(self, where) -> DataFrame:
        resolved = self.aliases.where(where & F.col("source_kind").isNotNull())
        last = last_line(F.col("start_line"), F.col("end_line"), F.col("end_char"))
        return resolved.select(
            "file", F.col("source_kind").alias("kind"), F.col("name").alias("name_path"), F.col("start_line").alias("first_line"), last.alias("last_line"),
            "start_line", "start_char", "end_line", "end_char", F.col("line").alias("sel_line"), F.col("char").alias("sel_char"),
        )

    @public
    def overview_json(self, request: OverviewRequest) -> str:
        items, percent = shape.limited_overview(shape.overview_items(self.overview(request)), self.budget)
        return shape.overview_json(items, percent).first().json

    # -- find ---------------------------------------------------------------

    def find(self, request: FindRequest) -> DataFrame:
        """Results of every adapter, merged: each runs only over its files."""
        request.validate()
        if request.scope.path and not request.scope.is_dir:
            names = [adapter_of_file(request.scope.path, self.registry)]
        else:
            names = sorted(set(self.registry.values()))
        return combine.merge_found([self._find_in(ADAPTERS[n], request) for n in names])

    def _find_in(self, adapter: Adapter, request: FindRequest) -> DataFrame:
        own = replace(request, path=adapter.rewrite(request.path))
        out = search.find(self._of(adapter), own, self.files, self.hover).drop("preorder")
        other = adapter.fallback(own.path)
        if other is not None:
            raw = search.find(self._of(adapter), replace(own, path=other), self.files, self.hover).drop("preorder")
            out = combine.first_non_empty(lambda: out, lambda: raw)
        if adapter.constants and own.include_info and not own.include_body and self.files is not None:
            text, leaf = F.col("_text"), strip_first_mark(F.substring_index("name_path", "/", -1))
            lines = F.replace(text, F.lit("\r\n"), F.lit("\n"))
            out = out.join(self.files.select("file", F.col("content").alias("_text")), "file", "left")
            out = out.withColumn("info", info_or_declaration(F.col("info"), lines, F.col("first_line"), F.col("last_line"), leaf)).drop("_text")
        kinds = kind_filter(F.col("kind"), own.include_kinds, own.exclude_kinds)
        scope = scope_filter(F.col("file"), own.scope.path, own.scope.is_dir)
        if adapter.constants and self.constants is not None:
            more = self.constants.where(scope & kinds & constant_pattern(own.path, F.col("name_path"), own.substring))
            told = lambda asked: F.col("declaration") if asked else F.lit(None).cast("string")
            out = combine.append_constants(out, more.select("kind", told(own.include_body).alias("body"), told(own.include_info).alias("info"), "name_path", "file", "first_line", "last_line"))
        if adapter.aliases and self.aliases is not None:
            more = self._alias_rows(scope & alias_pattern(own.path, F.col("name"), own.substring)).where(kinds)
            out = combine.append_aliases(out, self._with_alias_texts(more, own))
        return out.withColumn("name_path", rust_export(F.col("name_path"))) if adapter.export_rust else out

    def _with_alias_texts(self, rows: DataFrame, request: FindRequest) -> DataFrame:
        """Body and info, both if both are asked for. Positions count bytes."""
        body = info = F.lit(None).cast("string")
        if request.include_body and self.files is not None:
            rows = rows.join(self.files.select("file", F.col("content").alias("_text")), "file", "left")
            body = body_of(F.col("_text"), *(F.col(c) for c in ("start_line", "start_char", "end_line", "end_char")), by_bytes=True)
        if request.include_info and self.hover is not None:
            told = self.hover.select("file", F.col("line").alias("sel_line"), F.col("character").alias("sel_char"), F.col("text").alias("_info"))
            rows = rows.join(told, ["file", "sel_line", "sel_char"], "left")
            info = F.nullif(F.trim("_info"), F.lit(""))
        return rows.select("kind", body.alias("body"), info.alias("info"), "name_path", "file", "first_line", "last_line")

    @public
    def find_json(self, request: FindRequest) -> str:
        found = self.find(request)
        rows, percent = shape.limited_found(search.ranked(found, self.budget), self.budget, found.count())
        return shape.found_json(rows, percent).first().json

    # -- references -----------------------------------------------------------

    def references(self, request: ReferencesRequest) -> DataFrame:
        request.validate()
        adapter = self._adapter(request.file)
        path, file = adapter.rewrite(request.path), request.file
        if self.aliases is not None and adapter.aliases:
            spark = self.symbols.sparkSession
            target = combine.rewrite_target(spark.createDataFrame([(file, path.strip("/"))], "file string, path string"), self.aliases).first()
            path, file = ("/" + target.path, target.file) if target.file != file else (path, file)
        try:
            target = search.resolve(self.symbols, file, path)
        except SafeError:
            other = adapter.fallback(path)
            if other is None:
                raise
            target = search.resolve(self.symbols, file, other)
        refs = self.raw_references.where(
            (F.col("target_file") == file) & (F.col("target_line") == target.sel_line) & (F.col("target_char") == target.sel_char)
        ).select(F.col("seq").cast("long").alias("ref_id"), F.col("ref_file").alias("file"), "line", "char", "end_line")
        found = references.with_evidence(references.innermost(refs, self.symbols), self.files, F.col("end_line"))
        found = references.with_file_fallback(found, self.files.select("file", F.size(lines_of(F.col("content"))).alias("n_lines")))
        kept = references.keep_kinds(found, request.include_kinds, request.exclude_kinds)
        out = references.grouped(kept, ["content_start", "content_end", "content"])
        if adapter.constants and self.property_references is not None:
            out = self._with_property_references(out, request)
        return out.withColumn("name_path", rust_export(F.col("name_path"))) if adapter.export_rust else out

    def _with_property_references(self, found: DataFrame, request: ReferencesRequest) -> DataFrame:
        """Uses of a property that another tool lists by file and line, where
        the path names one property exactly. Each goes to the narrowest symbol
        of its line; the declaration's own line is no use."""
        path = "/" + request.path.strip().lstrip("/")
        kinds = (KIND["Property"], KIND["Field"])
        declared = search.find(self.symbols, FindRequest(path, Scope(request.file, False), include_kinds=kinds)).limit(2).collect()
        if len(declared) != 1 or "/" not in declared[0].name_path:
            return found
        own = declared[0]
        rows = self.property_references.where((F.col("declared_file") == own.file) & (F.col("property") == property_target(own.name_path)))
        rows = rows.where(~((F.col("file") == own.file) & (F.col("line") == own.first_line))).select("file", "line").distinct()
        held = references.smallest_by_lines(rows.withColumn("ref_id", F.xxhash64("file", "line")), self.symbols.where(F.col("depth") <= PROPERTY_DEPTH), request.include_kinds, request.exclude_kinds)
        held = held.join(self.files.select("file", F.col("content").alias("_text")).hint("merge"), "file")
        held = held.withColumns({"content": physical_line(F.col("_text"), F.col("line")), "content_start": F.col("line"), "content_end": F.col("line"), "char": F.lit(0)}).drop("_text")
        return combine.append_missing(found, references.grouped(held, ["content_start", "content_end", "content"]), ["file", "name_path"])

    @public
    def references_json(self, request: ReferencesRequest) -> str:
        found = self.references(request)
        ranked = shape.top_ranked(found, ["file", "content_start", "content_end", "name_path", "kind", "ref_id"], self.budget)
        incomplete = self.incomplete and self._adapter(request.file).incomplete
        rows, percent = shape.limited_references(ranked, self.budget, incomplete, found.count() if self.budget > 0 else None)
        return shape.references_json(rows, percent, incomplete).first().json


def supported(file: str, registry: dict[str, str]) -> None:
    if "." + file.rsplit(".", 1)[-1].lower() not in registry:
        raise unsupported_extension("." + file.rsplit(".", 1)[-1])
