"""Symbol kinds, requests, their validation, and public errors."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import PurePosixPath

# Symbol kinds, numbered from 1 in this order.
KINDS = [
    "File", "Module", "Namespace", "Package", "Class", "Method", "Property", "Field", "Constructor", "Enum", "Interface",
    "Function", "Variable", "Constant", "String", "Number", "Boolean", "Array", "Object", "Key", "Null", "EnumMember",
    "Struct", "Event", "Operator", "TypeParameter",
]
KIND = {name: i + 1 for i, name in enumerate(KINDS)}
FILE_KIND = KIND["File"]

SYMBOL_SCHEMA = (
    "file string, node_id long, parent_id long, depth int, preorder long, subtree_end long, ord_path array<int>, kind int, "
    "name_path string, leaf_base string, components array<string>, bases array<string>, "
    "start_line int, start_char int, end_line int, end_char int, sel_line int, sel_char int, first_line int, last_line int, "
    "anc array<struct<sl:int,sc:int,el:int,ec:int>>"
)


class SafeError(Exception):
    """A message that may be shown, and a private cause."""

    def __init__(self, message: str, cause: BaseException | None = None):
        super().__init__(message)
        self.message, self.cause = message, cause


def shown_path(path: str) -> str:
    return path.strip() or "."


def internal_error(cause: BaseException | None = None) -> SafeError:
    return SafeError("internal error", cause)


def unsupported_extension(ext: str) -> SafeError:
    return SafeError(f'files with extension "{ext}" are not supported')


def path_error(arg: str, path: str, what: str, cause: BaseException | None = None) -> SafeError:
    """``what`` is one of the keys below."""
    shown = f'{arg} "{shown_path(path)}"'
    # Texts of public path errors.
    texts = {
        "not_found": f"{shown} not found",
        "access": f"failed to access {shown}",
        "read": f"failed to read {shown}",
        "is_directory": f"{shown} points to a directory",
        "needs_extension": f"{shown} must point to a file with extension",
        "needs_directory": f"{shown} must point to a directory",
        "needs_absolute": f"{shown} must be absolute",
        "needs_relative": f"{shown} must be workspace-relative",
        "escapes": f"{shown} escapes workspace root",
    }
    return SafeError(texts[what], cause)


def ambiguous(path: str, candidates: list[str]) -> SafeError:
    return SafeError(f'multiple symbols match "{path}"; use a more specific symbol_path: ' + ", ".join(candidates))


def no_match(path: str) -> SafeError:
    return SafeError(f'no symbol matches "{path}"')


class ValidationError(ValueError):
    """All that is wrong with a request, one message a line."""

    #: Public names of arguments.
    NAMES = {"file": "file_path", "path": "symbol_path"}

    def __init__(self, problems: list[str]):
        self.problems = problems
        super().__init__("\n".join(problems))

    def public(self, path_name: str = "symbol_path") -> str:
        names = self.NAMES | {"path": path_name}
        return "; ".join(" ".join(names.get(w, w) for w in p.split(" ")) for p in self.problems)


def _kinds(label: str, kinds: tuple[int, ...]) -> list[str]:
    return [f"{label} has an invalid kind {k}: must be 1 to {len(KINDS)}" for k in kinds if not 1 <= k <= len(KINDS)]


@dataclass(frozen=True)
class Scope:
    """A whole workspace (empty), a file, or a directory."""

    path: str = ""
    is_dir: bool = True

    @staticmethod
    def of(path: str, is_dir: bool) -> Scope:
        clean = path.strip()
        if clean in ("", "."):
            return Scope()
        if PurePosixPath(clean).is_absolute():
            raise path_error("scope_path", path, "needs_relative")
        parts: list[str] = []
        for p in clean.split("/"):
            if p == "..":
                if not parts:
                    raise path_error("scope_path", path, "escapes")
                parts.pop()
            elif p not in ("", "."):
                parts.append(p)
        return Scope("/".join(parts), is_dir) if parts else Scope()


@dataclass(frozen=True)
class OverviewRequest:
    file: str
    depth: int = 0

    def validate(self) -> OverviewRequest:
        bad = [] if self.file.strip() else ["file is required"]
        bad += [] if self.depth >= 0 else ["depth must not be negative"]
        if bad:
            raise ValidationError(bad)
        return self


@dataclass(frozen=True)
class FindRequest:
    path: str
    scope: Scope = field(default_factory=Scope)
    include_kinds: tuple[int, ...] = ()
    exclude_kinds: tuple[int, ...] = ()
    depth: int = 0
    include_body: bool = False
    include_info: bool = False
    substring: bool = False

    def validate(self) -> FindRequest:
        bad = [] if self.path.strip() else ["path is required"]
        bad += [] if self.depth >= 0 else ["depth must not be negative"]
        bad += _kinds("include_kinds", self.include_kinds) + _kinds("exclude_kinds", self.exclude_kinds)
        if bad:
            raise ValidationError(bad)
        return self


@dataclass(frozen=True)
class ReferencesRequest:
    path: str
    file: str
    include_kinds: tuple[int, ...] = ()
    exclude_kinds: tuple[int, ...] = ()

    def validate(self) -> ReferencesRequest:
        bad = [] if self.path.strip() else ["path is required"]
        bad += [] if self.file.strip() else ["file is required"]
        bad += _kinds("include_kinds", self.include_kinds) + _kinds("exclude_kinds", self.exclude_kinds)
        if bad:
            raise ValidationError(bad)
        return self
