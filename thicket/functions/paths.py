"""Symbol paths: patterns compiled to predicates, and path arithmetic.

A path is components joined by ``/``. A component may end in ``@line:char``,
which tells equal siblings apart; without it, it is the component's base.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_DISCRIMINATED = re.compile(r"(?s)(.+)@([0-9]+:[0-9]+)\Z")
DISCRIMINATED_SQL = r"(?s)^(.+)@([0-9]+:[0-9]+)$"


def split_discriminator(component: str) -> tuple[str, str]:
    """Base, and ``line:char`` or nothing."""
    m = _DISCRIMINATED.match(component)
    return (m[1], m[2]) if m else (component, "")


def base_of(component: Column) -> Column:
    return F.regexp_replace(component, r"(?s)^(.+)@[0-9]+:[0-9]+\z", "$1")


@dataclass(frozen=True)
class Pattern:
    """A leading ``/`` asks for the full length; else any suffix matches. A
    component with a discriminator must be equal, others match by base. In
    substring mode the last component may be a part of the symbol's."""

    absolute: bool
    components: tuple[str, ...]
    substring: bool = False

    @staticmethod
    def parse(text: str, substring: bool = False) -> Pattern:
        text = text.strip()
        inner = text.strip("/")
        return Pattern(text.startswith("/"), tuple(inner.split("/")) if inner else (), substring)

    def matches(self, path: str) -> bool:
        """The same rule on the driver."""
        own = path.strip("/").split("/") if path.strip("/") else []
        if not self.components or len(self.components) > len(own) or (self.absolute and len(own) != len(self.components)):
            return False
        for k, want in enumerate(reversed(self.components)):
            have = own[-1 - k]
            base, mark = split_discriminator(want)
            if not mark:
                want, have = base, split_discriminator(have)[0]
            if not (want in have if k == 0 and self.substring else want == have):
                return False
        return True

    def predicate(self, components: str = "components", bases: str = "bases", leaf_base: str = "leaf_base") -> Column:
        """Over a symbols table. The last component is tested on its own
        column, so an exact one reaches the Parquet scan."""
        if not self.components:
            return F.lit(False)
        n = F.size(components)
        test = (n == len(self.components)) if self.absolute else (n >= len(self.components))
        for k, want in enumerate(reversed(self.components)):
            base, mark = split_discriminator(want)
            have = F.get(F.col(components if mark else bases), n - 1 - k)
            if k == 0 and not mark:
                have, want = F.col(leaf_base), base
            test = test & (F.contains(have, F.lit(want)) if k == 0 and self.substring else have == want)
            if k == 0 and mark and not self.substring:
                test = test & (F.col(leaf_base) == base)  # implied, and can be pushed down
        return test


def kind_filter(kind: Column, include: tuple[int, ...] = (), exclude: tuple[int, ...] = ()) -> Column:
    test = ~kind.isin(*exclude) if exclude else F.lit(True)
    return test & kind.isin(*include) if include else test


def scope_filter(file: Column, path: str, is_dir: bool) -> Column:
    if not path:
        return F.lit(True)
    return file.startswith(path + "/") if is_dir else file == path


def join_path(parent: Column, name: Column) -> Column:
    return F.when(F.coalesce(parent, F.lit("")) == "", name).otherwise(F.concat(parent, F.lit("/"), name))


def leaf_of(path: Column) -> Column:
    """After the last slash; the whole path if that is nothing."""
    tail = F.substring_index(path, "/", -1)
    return F.when(tail == "", path).otherwise(tail)


def parent_of(path: Column) -> Column:
    cut = F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1
    return F.when(cut > 0, F.left(path, cut)).otherwise("")


def last_line(start_line: Column, end_line: Column, end_char: Column) -> Column:
    """An end at character 0 of a later line is the line before."""
    return F.greatest(start_line, end_line - ((end_char == 0) & (end_line > start_line)).cast("int"))


def range_text(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first, last))


def position_in(line: Column, char: Column, sl: Column, sc: Column, el: Column, ec: Column) -> Column:
    """Start inclusive, end exclusive."""
    return ((line > sl) | ((line == sl) & (char >= sc))) & ((line < el) | ((line == el) & (char < ec)))


# -- per language -------------------------------------------------------------


#: A method's name: a receiver that is in brackets, a pointer, generic, of
#: another package or begins in upper case, then the method.
_GO_METHOD = re.compile(
    r"""(?xs) (?= [^.]*[()*\[] | .*[()*\[\]].*\. | .+\..+\. | [A-Z] )      # a receiver, not a package
        \s* \(? \s* \*? \(? (?: [^\[\].]+ \. )* (?P<type> [^\[\].()*\s]+ )  # its type, less package
        \s* (?: \[ .* \] )? \s* \)? \s* \. (?P<method> [^.]+ ) \Z"""
)


def go_path(parent: str, name: str) -> str:
    """``(*T[X]).M`` becomes ``T/M``; a plain dotted name stays."""
    method = _GO_METHOD.match(name)
    return plain_path(parent or method["type"], method["method"]) if method else plain_path(parent, name)


def plain_path(parent: str, name: str) -> str:
    return f"{parent}/{name}" if parent else name


#: A package is lower-case letters, digits and underscores; it qualifies a
#: symbol by a slash (where more follows) or by a dot.
_GO_PACKAGE = r"[^\W\d_A-Z][^\WA-Z]*"
_QUALIFIED = re.compile(rf"(?s)(?:(?P<folder>{_GO_PACKAGE})/(?=(?:{_GO_PACKAGE}\.)?[^\W\d_]))?(?:(?P<package>{_GO_PACKAGE})\.(?=[^\W\d_][^./]*(?:/|\Z)))?(?P<rest>.*)")


def go_query(path: str) -> str:
    """Drops a package qualifier from a relative query."""
    path = path.strip()
    if not path or path.startswith("/"):
        return path
    found = _QUALIFIED.fullmatch(path)
    lower = all(found[g] is None or found[g] == found[g].lower() for g in ("folder", "package"))
    return found["rest"] if lower else path


RUST_IMPL = "impl "


def rust_query(path: str) -> str | None:
    """The query that names the impl block of a member, if there is another."""
    parts = path.strip().split("/")
    if len(parts) < 2 or parts[-2].startswith(RUST_IMPL):
        return None
    parts[-2] = RUST_IMPL + parts[-2]
    return "/".join(parts)


def rust_export(path: Column) -> Column:
    """Strips ``impl `` from every component but the last."""
    parts = F.split(path, "/")
    stripped = F.transform(parts, lambda c, i: F.when((i < F.size(parts) - 1) & c.startswith(RUST_IMPL), F.substring(c, len(RUST_IMPL) + 1, 1 << 20)).otherwise(c))
    return F.array_join(stripped, "/")


def constant_pattern(path: str, name: Column, substring: bool = False) -> Column:
    """Top-level constants have one component; a part matches by case."""
    needle = path.strip().strip("/")
    if not needle or "/" in needle:
        return F.lit(False)
    return F.contains(name, F.lit(needle)) if substring else name == needle


def alias_pattern(path: str, name: Column, substring: bool = False) -> Column:
    """Re-exported names have one component; a part matches in any case."""
    needle = path.strip().strip("/")
    if not needle or "/" in needle:
        return F.lit(False)
    return F.contains(F.lower(name), F.lit(needle.lower())) if substring else name == needle


def strip_first_mark(text: Column) -> Column:
    return F.substring_index(text, "@", 1)


def property_target(path: str) -> str:
    """Last component of a property path, without its mark."""
    return path.strip().strip("/").split("/")[-1].split("@", 1)[0]


def extension(file: Column) -> Column:
    return F.lower(F.regexp_extract(file, r"(\.[^./]*)$", 1))


def stem(file: Column) -> Column:
    """Base name without its extension."""
    return F.regexp_replace(F.substring_index(file, "/", -1), r"\.[^.]*$", "")


def relative_from_uri(uri: Column, root: str) -> Column:
    """A file URI as a path relative to the workspace; outside it is an error."""
    path = F.url_decode(F.replace(F.regexp_replace(uri, r"^file://[^/]*", ""), F.lit("+"), F.lit("%2B")))
    clean = clean_path(path)
    top = "/".join(p for p in root.split("/") if p)
    inside = F.when(clean == top, ".").when(clean.startswith(top + "/"), F.substring(clean, len(top) + 2, 1 << 20))
    return F.coalesce(inside, F.raise_error(F.concat(F.lit("path points outside the workspace: "), path)).cast("string")) if top else clean


def clean_path(path: Column) -> Column:
    """``a/b/./../c`` to ``a/c``; a step above the root gives null."""
    step = lambda acc, p: F.when((p == "") | (p == "."), acc).when(p == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))).otherwise(F.array_append(acc, p))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
