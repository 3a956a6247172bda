"""Whether a workspace's index is complete, from progress events.

A token is tracked once it begins or reports with "index" in its title or
message; an end of a tracked token drops it; without tokens left the state is
idle. Both unknown and indexing mean that results may be incomplete.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

UNKNOWN, INDEXING, IDLE = "unknown", "indexing", "idle"


def step(state: str, tokens: set[str], kind: str, token: str, title: str, message: str) -> str:
    """The state after one event; ``tokens`` is changed in place."""
    if kind in ("begin", "report"):
        if token in tokens or "index" in f"{title} {message}".lower():
            tokens.add(token)
            return INDEXING
    elif kind == "end" and token in tokens:
        tokens.discard(token)
        return INDEXING if tokens else IDLE
    return state


def final_states(events: DataFrame) -> DataFrame:
    """Batch form, as window functions: ``workspace, state, incomplete``.

    A token's span opens at its first event that mentions the index since its
    last end, and closes at the next end. The workspace is idle once it has
    had a span and all are closed."""
    token = Window.partitionBy("workspace", "token").orderBy("seq")
    so_far = token.rowsBetween(Window.unboundedPreceding, -1)
    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("message", F.lit(""))))
    e = events.withColumn("_ends", F.coalesce(F.sum((F.col("kind") == "end").cast("int")).over(so_far), F.lit(0)))
    e = e.withColumn("_opens", (F.col("kind").isin("begin", "report") & F.contains(text, F.lit("index"))).cast("int"))
    spans = e.groupBy("workspace", "token", "_ends").agg(F.max("_opens").alias("opened"), F.max((F.col("kind") == "end").cast("int")).alias("closed"))
    per = spans.groupBy("workspace").agg(F.max("opened").alias("any"), F.max(((F.col("opened") == 1) & (F.col("closed") == 0)).cast("int")).alias("live"))
    state = F.when(F.col("any") == 0, UNKNOWN).when(F.col("live") == 1, INDEXING).otherwise(IDLE)
    return per.select("workspace", state.alias("state"), (state != IDLE).alias("incomplete"))


def stream_states(events: DataFrame) -> DataFrame:
    """Streaming form: the state of each workspace after each batch of it."""

    def update(key: tuple[str], batches: Iterable[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, packed = held.get if held.exists else (UNKNOWN, "[]")
        tokens = set(json.loads(packed))
        for e in pd.concat(list(batches)).sort_values("seq").itertuples():
            state = step(state, tokens, e.kind, e.token, e.title or "", e.message or "")
        held.update((state, json.dumps(sorted(tokens))))
        yield pd.DataFrame({"workspace": [key[0]], "state": [state], "incomplete": [state != IDLE]})

    return events.groupBy("workspace").applyInPandasWithState(
        update, "workspace string, state string, incomplete boolean", "state string, tokens string", "update", GroupStateTimeout.NoTimeout
    )


def with_incomplete(rows: DataFrame, states: DataFrame) -> DataFrame:
    """Marks results of workspaces that are not known to be complete."""
    own = states.select("workspace", F.col("incomplete").alias("_i"))
    return rows.join(own, "workspace", "left").withColumn("incomplete", F.coalesce("_i", F.lit(True))).drop("_i")
