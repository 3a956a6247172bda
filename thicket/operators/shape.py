"""Results as they are sent: nested groups within a budget of bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.paths import range_text
from thicket.functions.text import json_bytes
from thicket.model import SafeError

# Fixed value: the public text of a response that cannot be cut to size.
TOO_LARGE = "tool response is too large; narrow the query"


def top_ranked(rows: DataFrame, order: list[str], budget: int) -> DataFrame:
    """``rank`` from 1 in a total order. As an item takes more than a byte, no
    more than ``budget`` rows can be sent: each task keeps its own first ones,
    and only these are ranked together. Without a budget all rows are."""
    if budget > 0:
        rows = rows.orderBy(*order).limit(budget)
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def kind_groups(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows (``rank, kind, name_path, first_line, last_line``) grouped by kind,
    groups in the order of first appearance: ``group_rank``, ``pos`` (from 1)."""
    by = by or []
    first = F.min("rank").over(Window.partitionBy(*by, "kind"))
    out = rows.withColumn("_first", first)
    group = F.dense_rank().over(Window.partitionBy(*by).orderBy("_first"))
    pos = F.row_number().over(Window.partitionBy(*by, "kind").orderBy("rank"))
    return out.select(*by, "kind", group.alias("group_rank"), pos.alias("pos"), F.col("name_path").alias("path"), range_text(F.col("first_line"), F.col("last_line")).alias("range"))


def overview_items(rows: DataFrame) -> DataFrame:
    """An outline's rows in the order they are sent, group after group: this
    ``rank`` decides what a budget cuts off."""
    groups = kind_groups(rows)
    return groups.withColumn("rank", F.row_number().over(Window.orderBy("group_rank", "pos")))


def overview_json(items: DataFrame, percent: int | None = None) -> DataFrame:
    per = items.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("rank", F.struct("path", "range").alias("s")))).alias("v"))
    group = F.struct(F.element_at("v", 1).getField("rank").alias("r"), F.struct("kind", F.transform("v", lambda x: x["s"]).alias("symbols")).alias("g"))
    every = per.agg(F.array_sort(F.collect_list(group)).alias("v"))
    fields = [F.transform("v", lambda x: x["g"]).alias("groups"), F.lit(percent).cast("int").alias("returned_percent")]
    return every.select(F.to_json(F.struct(*fields)).alias("json"))


def found_item() -> Column:
    """Empty bodies and infos are left out, as nulls are."""
    return F.struct(
        "kind", F.nullif("body", F.lit("")).alias("body"), F.nullif("info", F.lit("")).alias("info"), F.col("name_path").alias("path"), "file",
        range_text(F.col("first_line"), F.col("last_line")).alias("range"),
    )


def reference_item() -> Column:
    return F.struct("kind", F.col("name_path").alias("path"), range_text(F.col("content_start"), F.col("content_end")).alias("range"), "content")


def returned_percent(kept: Column, total: Column) -> Column:
    """Of a cut result: 1 to 99, and 0 of nothing."""
    return F.when((kept <= 0) | (total <= 0), 0).otherwise(F.least(F.lit(99), F.greatest(F.lit(1), F.floor(100 * kept / total)))).cast("int")


def within_budget(rows: DataFrame, item: Column, budget: int, envelope: int, group: str | None = None, group_bytes: Column | None = None) -> DataFrame:
    """The longest prefix by ``rank`` whose JSON fits: ``size`` is the bytes of
    the response up to a row. ``envelope`` is an empty response's size; each
    row adds its item and a comma between two. With ``group``, rows of a group
    are neighbours and a new group adds ``group_bytes``. One pass of running
    sums; results are kilobytes, cut at ``rank <= budget`` (an item has more
    than a byte) before the single task that sums them."""
    if budget <= 0:
        return rows.withColumn("size", F.lit(None).cast("long"))
    near = rows.where(F.col("rank") <= budget)
    w = Window.orderBy("rank")
    own = json_bytes(F.to_json(item))
    if group is None:
        add = own + F.when(F.col("rank") > 1, 1).otherwise(0)
    else:
        new = F.coalesce(F.lag(group).over(w) != F.col(group), F.lit(True))
        # A new group: its own frame, and a comma unless it is the first.
        add = own + F.when(new, group_bytes + F.when(F.col("rank") > 1, 1).otherwise(0)).otherwise(1)
    sized = near.withColumn("_add", add).withColumn("size", (F.lit(envelope) + F.sum("_add").over(w.rowsBetween(Window.unboundedPreceding, 0))).cast("long"))
    return sized.where(F.col("size") <= budget).drop("_add")


OVERVIEW_ENVELOPE = len('{"groups":[]}')
FOUND_ENVELOPE = len('{"symbols":[]}')
FILES_ENVELOPE = len('{"files":[]}')
INCOMPLETE_BYTES = len(',"incomplete":true')


def file_frame(file: Column) -> Column:
    return json_bytes(F.to_json(F.struct(file.alias("file"), F.array().cast("array<int>").alias("symbols"))))


def kind_frame(kind: Column) -> Column:
    return json_bytes(F.to_json(F.struct(kind.alias("kind"), F.array().cast("array<int>").alias("symbols"))))


def limited_overview(items: DataFrame, budget: int) -> tuple[DataFrame, int | None]:
    """``items`` as ``overview_items`` ranks them."""
    fits = within_budget(items, F.struct("path", "range"), budget, OVERVIEW_ENVELOPE, "kind", kind_frame(F.col("kind")))
    return _limited(items, fits, budget, OVERVIEW_ENVELOPE)


def limited_found(ranked: DataFrame, budget: int, total: int | None = None) -> tuple[DataFrame, int | None]:
    """The rows that fit, and the percentage if some do not. ``total`` is how
    many there are, where ``ranked`` holds only the first."""
    return _limited(ranked, within_budget(ranked, found_item(), budget, FOUND_ENVELOPE), budget, FOUND_ENVELOPE, total)


def limited_references(ranked: DataFrame, budget: int, incomplete: bool = False, total: int | None = None) -> tuple[DataFrame, int | None]:
    base = FILES_ENVELOPE + INCOMPLETE_BYTES * incomplete
    return _limited(ranked, within_budget(ranked, reference_item(), budget, base, "file", file_frame(F.col("file"))), budget, base, total)


def _limited(rows: DataFrame, fits: DataFrame, budget: int, envelope: int, total: int | None = None) -> tuple[DataFrame, int | None]:
    if budget <= 0:
        return rows, None
    kept, total = fits.count(), rows.count() if total is None else total
    if kept == total:
        return rows, None
    if envelope >= budget or not kept:
        raise SafeError(TOO_LARGE)
    return fits, min(99, max(1, 100 * kept // total))


def found_json(rows: DataFrame, percent: int | None = None) -> DataFrame:
    items = rows.agg(F.array_sort(F.collect_list(F.struct("rank", found_item().alias("s")))).alias("v"))
    fields = [F.transform("v", lambda x: x["s"]).alias("symbols"), F.lit(percent).cast("int").alias("returned_percent")]
    return items.select(F.to_json(F.struct(*fields)).alias("json"))


def references_json(rows: DataFrame, percent: int | None = None, incomplete: bool = False) -> DataFrame:
    per = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("rank", reference_item().alias("s")))).alias("v"))
    group = F.struct(F.element_at("v", 1).getField("rank").alias("r"), F.struct("file", F.transform("v", lambda x: x["s"]).alias("symbols")).alias("g"))
    every = per.agg(F.array_sort(F.collect_list(group)).alias("v"))
    fields = [F.transform("v", lambda x: x["g"]).alias("files"), F.lit(True if incomplete else None).cast("boolean").alias("incomplete"), F.lit(percent).cast("int").alias("returned_percent")]
    return every.select(F.to_json(F.struct(*fields)).alias("json"))


def without_empty_groups(rows: DataFrame, count: int) -> DataFrame:
    """The first rows by rank; groups that lose all theirs go with them."""
    return rows.where(F.col("rank") <= count)
