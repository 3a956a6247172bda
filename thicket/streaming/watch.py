"""File changes applied to tables, in batches or as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def change_type(op: Column) -> Column:
    """Watcher's operations to created, changed, deleted; others are nothing."""
    return (
        F.when(op == "create", "created").when(op.isin("remove", "rename"), "deleted").when(op.isin("write", "chmod"), "changed")
    )


def file_events(events: DataFrame, relevant: Column | None = None) -> DataFrame:
    """Events (``path, op, is_dir, ts, seq``) on files inside the workspace. A
    created folder is watched from then on and is no event of a file."""
    inside = ~(F.col("path").startswith("../") | (F.col("path") == "..") | F.col("path").startswith("/"))
    folder = F.coalesce("is_dir", F.lit(False)) & (F.col("op") == "create")
    out = events.where(inside & ~folder).withColumn("change", change_type(F.col("op"))).where(F.col("change").isNotNull())
    return out if relevant is None else out.where(relevant)


def new_folders(events: DataFrame) -> DataFrame:
    return events.where(F.coalesce("is_dir", F.lit(False)) & (F.col("op") == "create")).select("path").distinct()


def last_change(events: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The latest change of each file; it alone decides what is to be done."""
    w = Window.partitionBy(*(by or []), "path").orderBy(F.desc("ts"), F.desc("seq"))
    return events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def apply_changes(table: DataFrame, events: DataFrame, fresh: DataFrame) -> DataFrame:
    """``table`` without the rows of files that changed or went, and with
    their new rows from ``fresh``; both have a column ``file``."""
    last = last_change(events)
    kept = table.join(last.select(F.col("path").alias("file")), "file", "left_anti")
    again = last.where(F.col("change") != "deleted").select(F.col("path").alias("file"))
    return kept.unionByName(fresh.join(again, "file", "left_semi"))


def follow(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Gives each micro-batch's last change a file to ``handle``."""

    def batch(df: DataFrame, epoch: int) -> None:
        handle(last_change(file_events(df)), epoch)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
