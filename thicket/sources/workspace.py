"""Workspaces as tables: listing, contents, scopes and adapters.

Spark's own file sources leave out names that start with ``_`` or ``.``, which
a workspace may well hold, so folders are listed here. Contents are then read
by tasks, not by the driver; the paths must be on storage that all see.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions.paths import extension
from thicket.model import SafeError, Scope, path_error, unsupported_extension

IgnoreDir = Callable[[str], bool]


def workspace_root(path: str) -> str:
    if not os.path.isabs(path.strip()):
        raise path_error("workspace_root", path, "needs_absolute")
    real = os.path.realpath(path.strip())
    if not os.path.exists(real):
        raise path_error("workspace_root", path, "not_found")
    if not os.path.isdir(real):
        raise path_error("workspace_root", path, "needs_directory")
    return real


def document_path(root: str, file: str, arg: str = "file_path") -> tuple[str, str]:
    """Relative and absolute path of a document inside a root."""
    name = file.strip()
    if os.path.isabs(name):
        raise path_error(arg, file, "needs_relative")
    inside = os.path.normpath(name)
    if inside == ".." or inside.startswith("../"):
        raise path_error(arg, file, "escapes")
    full = os.path.realpath(os.path.join(root, inside))
    if full != root and not full.startswith(root + os.sep):
        raise path_error(arg, file, "escapes")
    if not os.path.exists(full):
        raise path_error(arg, file, "not_found")
    if os.path.isdir(full):
        raise path_error(arg, file, "is_directory")
    return inside.replace(os.sep, "/"), full


def resolve_scope(root: str, path: str) -> Scope:
    scope = Scope.of(path, is_dir=True)
    if not scope.path:
        return scope
    full = os.path.join(root, scope.path)
    if not os.path.exists(full):
        raise path_error("scope_path", path, "not_found")
    return Scope(scope.path, os.path.isdir(full))


def list_files(root: str, folder: str = "", extensions: Sequence[str] | None = None, ignore: IgnoreDir | None = None, match_case: bool = False) -> list[str]:
    """Files under a folder, relative to the root and sorted by bytes. Folders
    that ``ignore`` names (by relative path) are not entered; the folder
    itself always is."""
    start, out = os.path.join(root, folder), []
    for at, folders, names in os.walk(start):
        rel = os.path.relpath(at, root)
        folders[:] = [d for d in folders if ignore is None or not ignore(os.path.normpath(os.path.join(rel, d)))]
        for name in names:
            ext = os.path.splitext(name)[1] if not (name.startswith(".") and name.count(".") == 1) else name
            if extensions is None or (ext if match_case else ext.lower()) in extensions:
                out.append(os.path.normpath(os.path.join(rel, name)).replace(os.sep, "/"))
    return sorted(out, key=lambda p: p.encode())


def scope_files(root: str, scope: Scope, extensions: Sequence[str], ignore: IgnoreDir | None = None) -> list[str]:
    """A single file of another extension gives nothing; it is no error."""
    if scope.path and not scope.is_dir:
        return [scope.path] if os.path.splitext(scope.path)[1].lower() in extensions else []
    return list_files(root, scope.path, extensions, ignore)


def workflow_files(root: str, target: str, extensions: Sequence[str], ignore: IgnoreDir | None = None) -> list[str]:
    """Files of the target's folder and below, the target last."""
    every = list_files(root, os.path.dirname(target), extensions, ignore)
    return [f for f in every if f != target] + [target]


def read_files(spark: SparkSession, root: str, files: Sequence[str]) -> DataFrame:
    """``file, ext, content, content_hash``; tasks read the contents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for f in pdf["file"]:
                try:
                    with open(os.path.join(root, f), "rb") as h:
                        texts.append(h.read().decode("utf-8", "replace"))
                except OSError as e:
                    raise path_error("file_path", f, "read", e) from e
            yield pdf.assign(content=texts)

    names = spark.createDataFrame([(f,) for f in files], "file string")
    return names.mapInPandas(run, "file string, content string").select("file", extension(F.col("file")).alias("ext"), "content", F.sha2("content", 256).alias("content_hash"))


def register(adapters: dict[str, Sequence[str]]) -> dict[str, str]:
    """Extension to adapter. One extension has one adapter."""
    out: dict[str, str] = {}
    for name, extensions in adapters.items():
        for ext in extensions:
            ext = ext.strip().lower()
            if not ext:
                raise ValueError(f"adapter {name} has an empty extension")
            if out.setdefault(ext, name) != name:
                raise ValueError(f"extension {ext} belongs to {out[ext]} and to {name}")
    return out


def with_adapter(files: DataFrame, registry: dict[str, str]) -> DataFrame:
    """Files that an adapter takes; the registry has a few dozen rows."""
    table = files.sparkSession.createDataFrame(sorted(registry.items()), "_ext string, adapter string")
    return files.join(F.broadcast(table), extension(F.col("file")) == F.col("_ext")).drop("_ext")


def adapters_of(files: DataFrame, registry: dict[str, str]) -> list[str]:
    return sorted(r.adapter for r in with_adapter(files.select("file"), registry).select("adapter").distinct().collect())


def adapter_of_file(file: str, registry: dict[str, str]) -> str:
    name = os.path.basename(file)
    ext = (name if name.startswith(".") and name.count(".") == 1 else os.path.splitext(name)[1]).lower()
    if not ext:
        raise path_error("file_path", file, "needs_extension")
    if ext not in registry:
        raise unsupported_extension(ext)
    return registry[ext]


__all__ = ["SafeError", "adapter_of_file", "adapters_of", "document_path", "list_files", "read_files", "register", "resolve_scope", "scope_files", "with_adapter", "workflow_files", "workspace_root"]
