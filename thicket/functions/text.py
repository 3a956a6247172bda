"""Text by UTF-16 positions, lines and snippets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Fixed value: how a hover text that is none begins.
NO_SOURCE = "Could not find source with "


def lines_of(content: Column) -> Column:
    """Split on line feeds alone; a carriage return stays with its line."""
    return F.split(content, "\n", -1)


def physical_line(content: Column, line: Column) -> Column:
    return F.get(F.split(F.replace(content, F.lit("\r\n"), F.lit("\n")), "\n", -1), line)


def utf16_width(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def _safe_column(units: Column, column: Column) -> Column:
    """A column inside a surrogate pair steps back to the pair's start."""
    clamped = F.greatest(F.lit(0), F.least(column, (F.octet_length(units) / 2).cast("int")))
    unit = F.hex(F.substring(units, 1 + 2 * clamped, F.lit(2)))
    return clamped - F.when(unit.between("DC00", "DFFF"), 1).otherwise(0)


def slice_utf16(line: Column, start: Column, end: Column) -> Column:
    units = F.encode(line, "UTF-16BE")
    a, b = _safe_column(units, start), _safe_column(units, end)
    return F.decode(F.substring(units, 1 + 2 * a, 2 * F.greatest(b - a, F.lit(0))), "UTF-16BE")


def slice_bytes(line: Column, start: Column, end: Column) -> Column:
    """By UTF-8 byte columns, for positions counted in bytes."""
    raw = F.encode(line, "UTF-8")
    a = F.greatest(F.lit(0), F.least(start, F.octet_length(raw)))
    b = F.greatest(a, F.least(end, F.octet_length(raw)))
    return F.decode(F.substring(raw, 1 + a, b - a), "UTF-8")


def body_of(content: Column, sl: Column, sc: Column, el: Column, ec: Column, by_bytes: bool = False) -> Column:
    """Text of a range; null where its lines are not in the content."""
    cut = slice_bytes if by_bytes else slice_utf16
    lines = lines_of(content)
    first, last = F.get(lines, sl), F.get(lines, el)
    width = F.octet_length(F.encode(first, "UTF-8")) if by_bytes else utf16_width(first)
    middle = F.when(el - sl > 1, F.slice(lines, sl + 2, F.greatest(el - sl - 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    many = F.array_join(F.concat(F.array(cut(first, sc, width)), middle, F.array(cut(last, F.lit(0), ec))), "\n")
    return F.when(sl == el, cut(first, sc, ec)).when((sl >= 0) & (el > sl) & last.isNotNull(), many)


def snippet(content: Column, start: Column, end: Column, around: int = 1) -> tuple[Column, Column, Column]:
    """First and last line, and text, of a range and its neighbours. An end
    beyond the text is an error, as is a negative line."""
    lines = lines_of(content)
    a = F.greatest(start - around, F.lit(0))
    b = F.least(end + around, F.size(lines) - 1)
    fine = (start >= 0) & (end >= start) & (end < F.size(lines))
    text = F.when(fine, F.array_join(F.slice(lines, a + 1, F.greatest(b - a + 1, F.lit(0))), "\n")).otherwise(
        F.raise_error(F.concat(F.lit("reference lies outside its file: line "), start)).cast("string")
    )
    return a, b, text


def offset_position(content: Column, offset: Column) -> tuple[Column, Column]:
    """Line and byte column of a byte offset."""
    head = F.substring(F.encode(content, "UTF-8"), F.lit(1), offset)
    text = F.decode(head, "UTF-8")
    line = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return line, F.octet_length(F.substring_index(text, "\n", -1))


def declaration_line(content: Column, first: Column, last: Column, leaf: Column) -> Column:
    """First non-blank line of a range that holds the leaf, else the first
    non-blank one, trimmed."""
    own = F.filter(F.transform(F.slice(lines_of(content), first + 1, F.greatest(last - first + 1, F.lit(0))), lambda x: F.trim(x, F.lit(" \t\r\n"))), lambda x: x != "")
    return F.coalesce(F.get(F.filter(own, lambda x: F.contains(x, leaf)), F.lit(0)), F.get(own, F.lit(0)))


def info_or_declaration(info: Column, content: Column, first: Column, last: Column, leaf: Column) -> Column:
    """Hover text, unless there is none or it only says that it has none; null
    if there is no such line either."""
    told = F.trim(F.coalesce(info, F.lit("")), F.lit(" \t\r\n"))
    missing = (told == "") | told.startswith(NO_SOURCE)
    return F.when(missing, declaration_line(content, first, last, leaf)).otherwise(told)


def json_bytes(text: Column) -> Column:
    """Bytes of JSON text once ``<``, ``>``, ``&`` and the two line separators
    are written as escapes of six."""
    count = lambda pattern: F.length(F.regexp_replace(text, f"[^{pattern}]", ""))
    return F.octet_length(text) + 5 * count("<>&") + 3 * count("\u2028\u2029")


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def clamp_uint32(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(value.cast("long"), F.lit(2**32 - 1)))
