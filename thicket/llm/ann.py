"""Approximate nearest neighbours by cosine: HNSW graphs, one a shard.

Equal vectors are one node that keeps the smallest ids, as many as a result can
need, so a vector that fills a third of the table costs one node and is never
gathered. Nodes are dealt over shards by a hash of their id; a shard is as large
as ``SHARD_BYTES`` of memory allow, since a search visits nearly as many nodes of
a small graph as of a large one. Each shard's graph is built by batched insertion
in numpy and stored as one row of flat arrays (levels of fixed-width neighbour
lists). Queries meet every shard in blocks of bounded size; a task passes on each
query's best of its shard, and a window keeps the best of all.

A result's score is the cosine in double precision on the original vectors;
ties go to the smaller id. Vectors that are null, empty, zero or hold null or
non-finite components take no part; only vectors of a query's own dimension are
its candidates. An id that comes more than once is one candidate, by its best
score; a repeated query id is one query, by its smallest vector. An empty table
or query set gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.llm._words import mix64
from thicket.storage import materialize

SHARD_BYTES = 8 << 20  # of the vectors of a graph, in double precision, about
LEAST_SHARD = 4096  # nodes, whatever their dimension
SEEN_BYTES = 16 << 20  # of the marks of visited nodes in a search
QUERY_BLOCK = 8192  # queries that meet a graph in one task
M, EF_BUILD, EF_SEARCH = 16, 64, 160
_NONE = np.float32(-np.inf)


def _fill(rows: np.ndarray, values: list[np.ndarray], n: int, empty: list) -> list[np.ndarray]:
    """Ragged values (sorted by row) as padded matrices."""
    count = np.bincount(rows, minlength=n)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    out = []
    for v, e in zip(values, empty):
        m = np.full((n, max(1, count.max(initial=0))), e, v.dtype)
        m[rows, at] = v
        out.append(m)
    return out


class Hnsw:
    """Vectors are unit rows of float32; level l's lists are rows of
    ``levels[l]`` (node numbers, -1 for none), for nodes at that level."""

    def __init__(self, vectors: np.ndarray, keys: np.ndarray):
        self.v = vectors
        self.levels: list[np.ndarray] = []
        n = len(vectors)
        u = (mix64(keys.view(np.uint64) ^ np.uint64(0xA5A5)) >> np.uint64(11)).astype(float) / 2.0**53
        self.height = np.minimum((-np.log(np.maximum(u, 1e-18)) / math.log(M)).astype(int), 8)
        self.entry = -1
        order = np.argsort(mix64(keys.view(np.uint64)), kind="stable")
        at = 0
        while at < n:
            step = min(256, max(16, at))
            self._insert(order[at : at + step])
            at += step

    # -- search ---------------------------------------------------------

    def _beam(self, level: int, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The ef nearest nodes found for each row of q, nearest first."""
        adj, b, n = self.levels[level], len(q), len(self.v)
        ids = np.full((b, ef), -1)
        sim = np.full((b, ef), _NONE, np.float32)
        done = np.zeros((b, ef), bool)
        ids[:, 0], sim[:, 0] = entry, np.einsum("ij,ij->i", q, self.v[entry])
        seen = np.zeros(b * n, np.int32)  # who visited a node first, from 1
        seen[np.arange(b) * n + entry] = 1
        width = min(4, ef)
        while True:
            open_ = np.where(done | (ids < 0), _NONE, sim)
            pick = np.argpartition(-open_, width - 1, axis=1)[:, :width] if width < ef else np.tile(np.arange(ef), (b, 1))
            live = np.take_along_axis(open_, pick, 1) > _NONE
            if not live.any():
                break
            r, k = np.nonzero(live)
            done[r, pick[r, k]] = True
            near = adj[ids[r, pick[r, k]]]
            row = np.repeat(r, near.shape[1])
            near = near.ravel()
            ok = near >= 0
            row, near = row[ok], near[ok]
            at = row * n + near
            at = at[seen[at] == 0]
            if not len(at):
                continue
            mark = np.arange(1, len(at) + 1, dtype=np.int32)
            seen[at] = mark
            at = at[seen[at] == mark]  # of equal ones, one
            row, near = at // n, at % n
            s = np.einsum("ij,ij->i", q[row], self.v[near])
            worst = sim.min(axis=1)
            ok = s > worst[row]
            row, near, s = row[ok], near[ok], s[ok]
            if not len(row):
                continue
            new_ids, new_sim = _fill(row, [near, s], b, [-1, _NONE])
            ids, sim = np.concatenate([ids, new_ids], 1), np.concatenate([sim, new_sim], 1)
            done = np.concatenate([done, np.zeros(new_ids.shape, bool)], 1)
            top = np.argpartition(-sim, ef - 1, axis=1)[:, :ef]
            ids, sim, done = (np.take_along_axis(x, top, 1) for x in (ids, sim, done))
        top = np.argsort(-sim, axis=1, kind="stable")
        return np.take_along_axis(ids, top, 1), np.take_along_axis(sim, top, 1)

    def _descend(self, q: np.ndarray, level: int) -> np.ndarray:
        """Nearest node found above ``level``, for each row of q."""
        entry = np.full(len(q), self.entry)
        for l in range(len(self.levels) - 1, level, -1):
            entry = self._beam(l, q, entry, 4)[0][:, 0]
        return entry

    def search(self, q: np.ndarray, k: int, ef: int = EF_SEARCH) -> np.ndarray:
        """Numbers of the k nearest nodes found, -1 where there are fewer."""
        out = np.full((len(q), k), -1)
        step = max(16, min(256, SEEN_BYTES // (4 * max(len(self.v), 1))))
        for lo in range(0, len(q), step):
            part = q[lo : lo + step]
            ids, _ = self._beam(0, part, self._descend(part, 0), max(ef, k))
            out[lo : lo + step, : ids.shape[1]] = ids[:, :k]
        return out

    # -- construction -----------------------------------------------------

    def _select(self, q: np.ndarray, ids: np.ndarray, sim: np.ndarray, m: int) -> np.ndarray:
        """At most m of each row's candidates (nearest first): one is taken if
        it is nearer to q than to all taken before; the nearest others fill up."""
        b, c = ids.shape
        kept = np.full((b, m), -1)
        vec = np.zeros((b, m, q.shape[1]), np.float32)
        n = np.zeros(b, int)
        taken = np.zeros((b, c), bool)
        rows = np.arange(b)
        for j in range(c):
            ok = (ids[:, j] >= 0) & (n < m)
            if not ok.any():
                continue
            x = self.v[np.maximum(ids[:, j], 0)]
            close = np.einsum("ij,imj->im", x, vec)
            close[np.arange(m)[None, :] >= n[:, None]] = _NONE
            ok &= close.max(axis=1) < sim[:, j]
            r = rows[ok]
            kept[r, n[r]], vec[r, n[r]], taken[r, j] = ids[r, j], x[r], True
            n[r] += 1
        for j in range(c):
            ok = (ids[:, j] >= 0) & (n < m) & ~taken[:, j]
            r = rows[ok]
            kept[r, n[r]] = ids[r, j]
            n[r] += 1
        return kept

    def _insert(self, batch: np.ndarray) -> None:
        high = int(self.height[batch].max())
        while len(self.levels) <= high:
            self.levels.append(np.full((len(self.v), 2 * M if not self.levels else M), -1, np.int32))
        old_entry = self.entry
        old_top = self.height[old_entry] if old_entry >= 0 else -1
        for level in range(high, -1, -1):
            own = batch[self.height[batch] >= level]
            q = self.v[own]
            mutual = q @ q.T
            mutual[np.triu_indices(len(own))] = _NONE  # earlier ones of the batch only
            near = np.argsort(-mutual, axis=1, kind="stable")[:, :M]
            sim = np.take_along_axis(mutual, near, 1)
            ids = np.where(sim > _NONE, own[near], -1)
            if level <= old_top:
                a, s = self._beam(level, q, self._descend(q, level), EF_BUILD)
                ids, sim = np.concatenate([ids, a], 1), np.concatenate([sim, s], 1)
            top = np.argsort(-sim, axis=1, kind="stable")
            ids, sim = np.take_along_axis(ids, top, 1), np.take_along_axis(sim, top, 1)
            kept = self._select(q, ids, sim, M)
            adj = self.levels[level]
            adj[own, :M] = kept
            self._link_back(level, own, kept)
        best = batch[np.argmax(self.height[batch])]
        if self.height[best] > old_top:
            self.entry = int(best)

    def _link_back(self, level: int, own: np.ndarray, kept: np.ndarray) -> None:
        adj = self.levels[level]
        width = adj.shape[1]
        r, k = np.nonzero(kept >= 0)
        to, frm = kept[r, k], own[r]
        order = np.argsort(to, kind="stable")
        to, frm = to[order], frm[order]
        if not len(to):
            return
        nodes, row = np.unique(to, return_inverse=True)
        (new,) = _fill(row, [frm], len(nodes), [-1])
        every = np.concatenate([adj[nodes], new], 1)
        sim = np.where(every >= 0, np.einsum("ij,ikj->ik", self.v[nodes], self.v[np.maximum(every, 0)]), _NONE)
        top = np.argsort(-sim, axis=1, kind="stable")
        every, sim = np.take_along_axis(every, top, 1), np.take_along_axis(sim, top, 1)
        few = (every >= 0).sum(1) <= width
        out = every[:, :width].copy() if every.shape[1] >= width else np.pad(every, ((0, 0), (0, width - every.shape[1])), constant_values=-1)
        if not few.all():
            out[~few] = self._select(self.v[nodes[~few]], every[~few], sim[~few], width)
        adj[nodes] = out

    # -- flat form ----------------------------------------------------------

    def dump(self) -> bytes:
        """Heights, entry and lists of every level, one after another."""
        head = np.array([len(self.v), self.entry, len(self.levels)], "<i8")
        parts = [head.tobytes(), self.height.astype("<i1").tobytes()]
        for level, adj in enumerate(self.levels):
            parts.append(adj[self.height >= level].astype("<i4").tobytes())
        return b"".join(parts)

    @classmethod
    def load(cls, flat: bytes, vectors: np.ndarray) -> Hnsw:
        self = cls.__new__(cls)
        n, self.entry, count = (int(x) for x in np.frombuffer(flat, "<i8", 3))
        self.v, self.height, self.levels, at = vectors, np.frombuffer(flat, "<i1", n, 24).astype(int), [], 24 + n
        for level in range(count):
            nodes = np.flatnonzero(self.height >= level)
            width = 2 * M if level == 0 else M
            adj = np.full((n, width), -1, np.int32)
            adj[nodes] = np.frombuffer(flat, "<i4", len(nodes) * width, at).reshape(-1, width)
            self.levels.append(adj)
            at += 4 * len(nodes) * width
        return self


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row by a power of two of its own, which is exact and leaves its
    cosines as they are, so that its largest component is 0.5 to 1: squares then
    neither overflow nor vanish. Rows of ordinary size stay as they are."""
    top = np.abs(vectors).max(axis=1)
    if ((top > 1e-60) & (top < 1e60)).all():
        return vectors
    return np.ldexp(vectors, -np.frexp(top)[1][:, None])


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = _scaled(vectors)
    return (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise, in double."""
    a, b = _scaled(a), _scaled(b)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def valid_vectors(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.where(F.col(f"`{id_col}`").isNotNull() & (F.size(v) > 0) & fine).select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"))


def build(rows: DataFrame, k: int, shard_size: int | None = None) -> DataFrame:
    """Graphs: ``dim, shard, ids`` (k + 1 smallest ids of each node, -1 for
    none), ``vectors`` (doubles) and ``graph``, all flat. ``rows``: id, v. A
    shard holds about ``shard_size`` nodes; by default what memory allows."""
    first = Window.partitionBy("v").orderBy("id")
    nodes = rows.withColumn("r", F.dense_rank().over(first)).where(F.col("r") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    nodes = materialize(nodes, "nodes")
    dim = F.size("v").alias("dim")
    sizes = {r.dim: r["count"] for r in nodes.groupBy(dim).count().collect()}  # a row a dimension
    shards = {d: max(1, math.ceil(n / (shard_size or max(LEAST_SHARD, SHARD_BYTES // (8 * d))))) for d, n in sizes.items()}
    deal = F.create_map(*[F.lit(x) for pair in (shards or {0: 1}).items() for x in pair])
    dealt = nodes.select(dim, F.pmod(F.xxhash64(F.element_at("ids", 1)), deal[F.size("v")]).cast("int").alias("shard"), "ids", "v")

    def make(table: pa.Table) -> pa.Table:
        ids = table.column("ids").combine_chunks()
        v = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        flat, off = ids.flatten().to_numpy(), np.append(0, np.cumsum(ids.value_lengths().to_numpy()))
        own = np.full((len(ids), k + 1), -1, "<i8")
        size = np.diff(off)
        own[np.repeat(np.arange(len(ids)), size), np.arange(len(flat)) - np.repeat(off[:-1], size)] = flat
        order = np.argsort(own[:, 0], kind="stable")
        own, v = own[order], np.ascontiguousarray(v[order])
        graph = Hnsw(_unit(v), np.ascontiguousarray(own[:, 0])).dump()
        return pa.table({"dim": table.column("dim")[:1], "shard": table.column("shard")[:1], "ids": pa.array([own.tobytes()], pa.binary()), "vectors": pa.array([v.astype("<f8").tobytes()], pa.binary()), "graph": pa.array([graph], pa.binary())})

    # One task a graph, as far as hashes part them: building is the long step.
    dealt = dealt.repartition(max(1, min(1 << 15, 2 * sum(shards.values()))), "dim", "shard")
    return dealt.groupBy("dim", "shard").applyInArrow(make, "dim int, shard int, ids binary, vectors binary, graph binary")


def nearest(df: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", shard_size: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``df`` on which
    ``queries`` (a condition on ``df``) holds, against all other rows."""
    rows = valid_vectors(df, id_col, vector)
    graphs = materialize(build(rows, k, shard_size), "graphs")
    asked = valid_vectors(df.where(queries), id_col, vector).groupBy("id").agg(F.min("v").alias("v"))
    asked = materialize(asked, "asked")
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))
    shards = graphs.select(F.col("dim").alias("dim"), F.col("shard").alias("shard"))
    left = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).join(shards, "dim")

    def search(graph: pa.Table, query: pa.Table) -> pa.Table:
        names = ["query_id", "score", "vec_id"]
        kinds = [pa.int64(), pa.float64(), pa.int64()]
        if not len(graph) or not len(query):
            return pa.table([pa.array([], t) for t in kinds], names)
        own = np.frombuffer(graph.column("ids")[0].as_buffer(), "<i8").reshape(-1, k + 1)
        v = np.frombuffer(graph.column("vectors")[0].as_buffer(), "<f8").reshape(len(own), -1)
        index = Hnsw.load(graph.column("graph")[0].as_py(), _unit(v))
        qid = query.column("id").to_numpy()
        q = query.column("v").combine_chunks().flatten().to_numpy().reshape(len(qid), -1)
        found = index.search(_unit(q), 2 * k + 2)
        row, col = np.nonzero(found >= 0)
        node = found[row, col]
        score = cosine(q[row], v[node])
        row, score, ids = np.repeat(row, k + 1), np.repeat(score, k + 1), own[node].ravel()
        ok = (ids >= 0) & (ids != qid[row])
        row, score, ids = row[ok], score[ok], ids[ok]
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        ok = rank < 2 * k
        return pa.table([pa.array(qid[row[ok]]), pa.array(score[ok]), pa.array(ids[ok])], names)

    key = ["dim", "shard", "block"]
    hits = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, "query_id long, score double, vec_id long")
    best = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
