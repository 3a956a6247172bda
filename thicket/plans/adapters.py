"""What differs by language: files, folders, paths and orders."""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from thicket.functions.paths import extension, go_query, rust_query


@dataclass(frozen=True)
class Adapter:
    name: str
    extensions: tuple[str, ...]
    ignored: tuple[str, ...] = ()
    ignore_hidden: bool = True
    build_path: str = "plain"
    languages: tuple[tuple[str, tuple[str, ...]], ...] = ()
    sort_overview: bool = False
    export_rust: bool = False
    constants: bool = False
    aliases: bool = False
    incomplete: bool = False
    watched_names: tuple[str, ...] = ()
    match_case: bool = False
    list_case: bool = False
    rewrite: Callable[[str], str] = str.strip
    fallback: Callable[[str], str | None] = lambda path: None

    def ignores(self, folder: str) -> bool:
        base = posixpath.basename(folder)
        return (self.ignore_hidden and base.startswith(".")) or base in self.ignored

    def watches(self, path: Column) -> Column:
        ext = F.regexp_extract(path, r"(\.[^./]*)$", 1) if self.match_case else extension(path)
        own = self.extensions if self.match_case else [e.lower() for e in self.extensions]
        return ext.isin(list(own)) | F.substring_index(path, "/", -1).isin(list(self.watched_names))

    def lists(self, file: Column) -> Column:
        """Files of the adapter's extensions with no ignored folder above."""
        ext = F.regexp_extract(file, r"(\.[^./]*)$", 1)
        own = ext.isin(list(self.extensions)) if self.list_case else F.lower(ext).isin([e.lower() for e in self.extensions])
        folders = F.slice(F.split(file, "/"), 1, F.greatest(F.size(F.split(file, "/")) - 1, F.lit(0)))
        ignored = F.exists(folders, lambda d: d.isin(list(self.ignored)) | (F.lit(self.ignore_hidden) & d.startswith(".")))
        return own & ~ignored

    def language(self, ext: Column) -> Column:
        """Language of a file by its extension; the last one named is the default."""
        out = F.lit(self.languages[-1][0] if self.languages else self.name)
        for name, own in self.languages[::-1]:
            out = F.when(ext.isin(*own), name).otherwise(out)
        return out


# Extensions, ignored folders and language names by adapter.
ADAPTERS = {
    a.name: a
    for a in [
        Adapter("go", (".go",), build_path="go", rewrite=go_query, match_case=True, watched_names=("go.mod", "go.sum", "go.work", "go.work.sum")),
        Adapter(
            "typescript", (".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs"), ("node_modules", "dist", "build", "coverage"), aliases=True, list_case=True,
            languages=(("typescriptreact", (".tsx",)), ("javascript", (".js", ".mjs", ".cjs")), ("javascriptreact", (".jsx",)), ("typescript", (".ts", ".mts", ".cts"))),
        ),
        Adapter("markdown", (".md", ".markdown"), ignore_hidden=False),
        Adapter("python", (".py", ".pyi"), ("__pycache__", "venv", ".venv", ".env", ".pixi", "build", "dist")),
        Adapter(
            "clangd", (".c", ".C", ".cc", ".CC", ".cp", ".cpp", ".CPP", ".cxx", ".CXX", ".c++", ".C++", ".h", ".H", ".hh", ".hpp", ".hxx", ".ccm", ".cppm", ".cxxm", ".c++m"),
            languages=(("c", (".c",)), ("cpp", (".cpp",))), incomplete=True, watched_names=("compile_commands.json", "compile_flags.txt"),
        ),
        Adapter("php", (".php",), ("node_modules", "cache"), sort_overview=True, constants=True),
        Adapter("rust", (".rs",), ("target",), export_rust=True, fallback=rust_query),
    ]
}
