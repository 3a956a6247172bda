"""Connected components of a distributed edge list.

Alternating large-star and small-star steps; each groups by a node and only
takes a minimum, so a hub is combined map-side and its edges are joined, not
gathered. Tasks first contract their own edges by union-find. Every round is
written to the shared folder, so the lineage stays short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm._words import tidy
from thicket.storage import forget, materialize


class UnionFind:
    """Over numbers; the root is the smallest of a set."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (p := self.up.get(root, root)) != root:
            root = p
        while x != root:
            self.up[x], x = root, self.up.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        a, b = min(a, b), max(a, b)
        self.up[b] = a
        self.up.setdefault(a, a)
        return True

    def stars(self) -> tuple[list[int], list[int]]:
        """Root and member of every node that is not a root."""
        roots, nodes = [], []
        for x in list(self.up):
            r = self.find(x)
            if r != x:
                roots.append(r)
                nodes.append(x)
        return roots, nodes


#: A task's union-find is emptied at so many nodes, which bounds its memory.
NODES = 1 << 20


def contract(edges: DataFrame) -> DataFrame:
    """Edges ``a < b`` of the same components, stars within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = UnionFind()

        def out() -> pa.RecordBatch:
            a, b = sets.stars()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            pair = np.unique(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1), axis=0)
            for x, y in pair.tolist():
                sets.join(x, y)
            if len(sets.up) > NODES:
                yield out()
                sets = UnionFind()
        yield out()

    # Dealt by node, so that a node of many edges is in one task's star only.
    return edges.select("a", "b").repartition("b").mapInArrow(tidy(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an edge, the root being the smallest
    node of its component. ``edges`` has long columns ``a`` and ``b``."""
    edges = materialize(contract(edges).distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: larger neighbours of a node move to its least neighbour.
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # Small star: a node and its smaller neighbours move to the least one.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        moved = large.join(low, "b").select("m", F.explode(F.array("a", "b")).alias("b")).select(F.col("m").alias("a"), "b").where("a < b").distinct()
        new = materialize(moved, "edges")
        same = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if same == new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first():
            break
        forget(edges)
        edges = new
    nodes = new.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return nodes.union(nodes.select(F.col("root").alias("node"), "root").distinct())
