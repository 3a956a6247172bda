"""N-gram Jaccard join: exact near-duplicate classes over word shingles.

1. Every text becomes its set of 64-bit shingle hashes, each made of two lanes
   of hashes of its words; texts whose sets agree in size and in a hash of 128
   bits are one class, represented by their smallest id.
2. Occurrence filter. A partner shares all but ``d = n - ceil(t * n)`` of a
   set's n shingles, so a set with more than ``d`` shingles found in no other
   class has none. The shingles are dealt over parts by hash and counted there,
   a slice of the hash space at first (``d`` holds for any slice as well).
3. What is left is dealt into candidate clusters. Two sets of like size that
   differ in at most ``D`` shingles agree wholly on one of ``D + 1`` parts of
   the hash space at least, so equal parts meet as keys, and keys link classes
   in stars, never in pairs.
4. T-occurrence search in each cluster: for every set, by descending size, the
   inverted lists of its shingles are searched by DivideSkip. The longest lists
   are set aside; the short ones are merged, and only sets that occur often
   enough in them are looked up in the long ones by binary search. Those that
   reach the required overlap are links. A cluster beyond ``BLOCK`` sets is
   searched in blocks, each with some sets of the whole cluster. If that leaves
   several components, its sets are dealt anew by stricter keys, which unlike
   sets seldom share, and what is outside the largest component of such a
   cluster is searched block against block, in tasks of their own.
5. Links join classes into components.

No step emits pairs of copies, gathers a class or a key in one place, or
collects more than counts. Steps 2 and 3 lose no pair, whatever the data.

Null and empty texts, and those without words, have the empty set and link to
nothing. A text of fewer words than a shingle is one shingle of them all. Rows
with the same id are one document (their sets are joined to one by the smallest
hash). An empty table gives an empty result. Null ids are left out.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.llm._components import UnionFind, components
from thicket.llm._words import Words, chunks, distinct_per_row, mix64, shingles, tidy
from thicket.llm.bpe import binary_rows
from thicket.storage import forget, materialize

WORDS, PERCENT = 5, 80
DEAL_SHINGLES = 1 << 20  # that a task deals out at a time
PART_SHINGLES = 1 << 21  # that a task of the occurrence filter holds, about
BLOCK = 256  # sets of a block of a large cluster
PIVOTS = 16  # sets of a large cluster that meet all others
FEW_TASKS = 100_000  # rows of 40 bytes that may be broadcast
_U = np.uint64


def required(nx: np.ndarray | int, ny: np.ndarray | int, percent: int):
    """Least overlap of a link: 100 * i >= percent * (nx + ny - i)."""
    return -(-percent * (nx + ny) // (100 + percent))


def spare(n, percent: int):
    """Shingles of a set of n that a partner may lack."""
    return n - -(-percent * n // 100)


def _sets(column: pa.Array, words: int):
    """For each chunk: it, sorted distinct shingles, their offsets, and two hashes of each set."""
    for chunk in chunks(column):
        flat, off = distinct_per_row(*shingles(Words(chunk, lower=True), words))
        hashes = []
        for salt in (_U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(flat ^ salt), dtype=np.uint64)])
            hashes.append(mix64(np.diff(total[off]) + np.diff(off).astype(np.uint64)).view(np.int64))
        yield chunk, flat, off, *hashes


def _slice_of(percent: int) -> float:
    """Share of the hash space that the filter looks at: enough that sets
    with two fifths of their shingles to themselves are told apart."""
    return min(1.0, (100 - percent) / 40)


def set_rows(source: DataFrame, words: int) -> DataFrame:
    """``id, n, h, h2``: size and hashes of every document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, _, off, h, h2 in _sets(batch.column(1), words):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), pa.array(np.diff(off)), pa.array(h), pa.array(h2)], ["id", "n", "h", "h2"])

    return source.mapInArrow(tidy(run), "id long, n long, h long, h2 long")


def lone_shingles(source: DataFrame, words: int, percent: int, n_parts: int) -> DataFrame:
    """``h, lone``: for sets that have any, how many of the looked-at shingles
    are in no other class."""
    top = int(_slice_of(percent) * 2**32)
    n_buckets = max(1, n_parts // 4)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        waiting = 0

        def out() -> pa.RecordBatch:
            h, size, high, low = (np.concatenate([x[k] for x in held]) for k in range(4))
            row = np.repeat(np.arange(len(h)), size)
            firsts = np.zeros(len(h), bool)
            firsts[np.unique(h, return_index=True)[1]] = True
            once = firsts[row]  # copies go no further than this task
            row, part, low = row[once], (high * n_parts // max(top, 1))[once], low[once]
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(n_parts + 1))
            rows = []
            for p in range(n_parts):
                at = order[cut[p] : cut[p + 1]]
                if len(at):
                    own, count = np.unique(row[at], return_counts=True)
                    rows.append((p, h[own].tobytes(), count.astype("<u4").tobytes(), low[at].tobytes()))
            held.clear()
            kinds = [pa.int32()] + [pa.binary()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, kinds)], ["p", "hs", "counts", "low"])

        for batch in batches:
            for chunk, flat, off, h, _ in _sets(batch.column(1), words):
                high = (flat >> _U(32)).astype(np.int64)
                seen = high < top
                size = np.diff(np.concatenate([[0], np.cumsum(seen)])[off])
                low = (flat[seen] & _U(0xFFFFFFFF)) ^ (mix64(flat[seen] >> _U(32)) & _U(0xFFFFFFFF))
                held.append((h, size, high[seen], low.astype("<u4")))
                waiting += len(low) + len(chunk)
                if waiting >= DEAL_SHINGLES:
                    yield out()
                    waiting = 0
        if held:
            yield out()

    def count(table: pa.Table) -> pa.Table:
        hs, counts, lows = (b"".join(x) for x in (table.column(i).to_pylist() for i in range(1, 4)))
        h, size, low = np.frombuffer(hs, "<i8"), np.frombuffer(counts, "<u4"), np.frombuffer(lows, "<u4")
        firsts = np.zeros(len(h), bool)
        firsts[np.unique(h, return_index=True)[1]] = True
        keep = np.repeat(firsts, size)  # a class counts once
        h, size, low = h[firsts], size[firsts], low[keep]
        every = np.sort(low)
        start = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        single = every[start[np.diff(np.append(start, len(every))) == 1]]
        if len(single):
            alone = single[np.minimum(np.searchsorted(single, low), len(single) - 1)] == low
        else:
            alone = np.zeros(len(low), bool)
        lone = np.bincount(np.repeat(np.arange(len(h)), size), alone, len(h)).astype("<i4")
        h, lone = h[lone > 0], lone[lone > 0]
        bucket = (mix64(h.view(np.uint64)) % _U(n_buckets)).astype(np.int64)
        rows = [(b, h[bucket == b].tobytes(), lone[bucket == b].tobytes()) for b in np.unique(bucket).tolist()]
        cols = zip(*rows) if rows else [()] * 3
        return pa.table([pa.array(c, k) for c, k in zip(cols, [pa.int32(), pa.binary(), pa.binary()])], ["b", "hs", "lone"])

    def total(table: pa.Table) -> pa.Table:
        h, lone = (np.frombuffer(b"".join(table.column(i).to_pylist()), k) for i, k in ((1, "<i8"), (2, "<i4")))
        own, at = np.unique(h, return_inverse=True)
        return pa.table({"h": own, "lone": np.bincount(at, lone, len(own)).astype(np.int64)})

    dealt = source.mapInArrow(tidy(deal), "p int, hs binary, counts binary, low binary")
    counted = dealt.groupBy("p").applyInArrow(count, "b int, hs binary, lone binary")
    return counted.groupBy("b").applyInArrow(total, "h long, lone long")


def part_keys(flat: np.ndarray, off: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of parts of each set's hash space, and the set of each key. Sets
    meet in groups of two neighbouring size classes."""
    keys, owner = [], []
    n = np.diff(off)
    ratio = math.log(100 / percent)
    for i in np.flatnonzero(n):
        own = flat[off[i] : off[i + 1]]
        level = int(math.log(n[i]) / ratio + 1e-9)
        for group in (level, level + 1):
            most = math.ceil(math.exp(ratio * (group + 1)) + 1e-6)  # above any size of the group
            differ = 2 * most * (100 - percent) // (100 + percent)
            if not differ:
                continue  # only an equal set would do
            m = differ + 3 + differ // 12  # a few more parts, as some are empty
            part = ((own >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
            there, first = np.unique(part, return_index=True)  # own is sorted, so parts are
            made = np.add.reduceat(mix64(own ^ _U(0x2545F4914F6CDD1D)), first)
            if m - len(there) >= m - differ:
                # All parts that must agree may be empty ones: these count too.
                # A partner has as many of them, so it comes here as well.
                empty = np.setdiff1d(np.arange(m), there)
                there = np.concatenate([there, empty])
                made = np.concatenate([made, np.zeros(len(empty), np.uint64)])
            keys.append(mix64(made + mix64(there.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(group))))
            owner.append(np.full(len(there), i))
    return (np.concatenate(keys), np.concatenate(owner)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def near_part_keys(own: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Stricter keys of one sorted set, and which of them lack a shingle. Half as
    many parts as ``part_keys`` has, and one more: of these, one differs in a
    single shingle at most, so its whole equals the other's whole, or the
    other's with one shingle left out."""
    keys, less = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    ratio = math.log(100 / percent)
    level = int(math.log(len(own)) / ratio + 1e-9)
    value = mix64(own ^ _U(0x71D67FFFEDA60000))
    for group in (level, level + 1):
        most = math.ceil(math.exp(ratio * (group + 1)) + 1e-6)
        differ = 2 * most * (100 - percent) // (100 + percent)
        if not differ:
            continue
        m = differ // 2 + 3 + differ // 10
        part = ((own >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
        there, first = np.unique(part, return_index=True)
        whole = np.zeros(m, np.uint64)
        whole[there] = np.add.reduceat(value, first)
        held = np.bincount(part, minlength=m)
        made = np.concatenate([whole, whole[part] - value])
        where = np.concatenate([np.arange(m), part])
        lacks = np.arange(len(made)) >= m
        if (held <= 2).sum() < m - differ // 2:
            # More parts must be near than are small here, so a larger one is:
            # keys of fewer than two shingles, which many sets have, go.
            large = np.concatenate([held, held[part] - 1]) >= 2
            made, where, lacks = made[large], where[large], lacks[large]
        keys.append(mix64(made + mix64(where.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(group))))
        less.append(lacks)
    return np.concatenate(keys), np.concatenate(less)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, less, rep): a link from a key's first rep to
    others, if the first is a whole (not ``less``)."""
    key = head = None
    whole = False
    for batch in batches:
        k, less, rep = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(k):
            continue
        new = np.append(True, k[1:] != k[:-1])
        if k[0] == key:
            new[0] = False
        at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
        first = np.where(at >= 0, rep[np.maximum(at, 0)], 0 if head is None else head)
        sound = np.where(at >= 0, ~less[np.maximum(at, 0)], whole)
        pair = np.unique(np.stack([first, rep], 1)[(first != rep) & sound], axis=0)
        key, head, whole = k[-1], first[-1], sound[-1]
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])


def _clusters(keyed: DataFrame) -> DataFrame:
    """``node, root`` of the rows ``key, less, rep`` that keys bring together."""
    stars = keyed.repartition("key").sortWithinPartitions("key", "less", "rep").mapInArrow(tidy(_stars), "a long, b long")
    return materialize(components(stars), "clusters")


def _finer(sets: DataFrame, percent: int) -> DataFrame:
    """``node, root``: clusters of the stricter keys. ``sets``: rep, hashes."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep = batch.column(0).to_numpy()
            for lo in range(0, len(rep), 256):
                made = [near_part_keys(np.frombuffer(x.as_buffer(), "<u8"), percent) for x in batch.column(1)[lo : lo + 256]]
                k, less = (np.concatenate(x) for x in zip(*made))
                owner = np.repeat(rep[lo : lo + 256], [len(x) for x, _ in made])
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(less), pa.array(owner)], ["key", "less", "rep"])

    return _clusters(sets.select("rep", "hashes").mapInArrow(tidy(keys), "key long, less boolean, rep long"))


def merge_skip(lists: list[list[int]], least: int) -> list[tuple[int, int]]:
    """Numbers that occur in ``least`` of the sorted lists or more, and in how
    many. A heap holds each list's head; where the top occurs too seldom, so
    many heads are dropped that one list less than ``least`` is out, and these
    lists jump by binary search to the next number that may still do."""
    heap = [(x[0], i) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    at, out = [0] * len(lists), []
    while len(heap) >= least:
        top, out_of = heap[0][0], []
        while heap and heap[0][0] == top:
            out_of.append(heapq.heappop(heap)[1])
        if len(out_of) >= least:
            out.append((top, len(out_of)))
            goal = top + 1
        else:
            while heap and len(out_of) < least - 1:
                out_of.append(heapq.heappop(heap)[1])
            if not heap:
                break  # fewer lists are left than are needed
            goal = heap[0][0]
        for i in out_of:
            own = lists[i]
            at[i] = bisect_left(own, goal, at[i])
            if at[i] < len(own):
                heapq.heappush(heap, (own[at[i]], i))
    return out


class Searcher:
    """T-occurrence search among sets of a cluster, over inverted lists of
    their shingles."""

    def __init__(self, sets: list[np.ndarray]):
        flat = np.concatenate(sets)
        self.size = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), self.size)
        values, code = np.unique(flat, return_inverse=True)
        order = np.lexsort((owner, code))
        begin = np.searchsorted(code[order], np.arange(len(values) + 1))
        every = owner[order].tolist()
        self.lists = [every[a:b] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
        self.length = np.diff(begin)
        self.code = np.split(code, np.cumsum(self.size)[:-1])

    def overlaps(self, x: int, percent: int, others: np.ndarray) -> np.ndarray:
        """Sets y of the mask ``others`` that link with x, by DivideSkip."""
        code = self.code[x]
        need = required(self.size[x], self.size, percent)
        able = others & (need <= np.minimum(self.size[x], self.size))
        if not able.any():
            return np.zeros(0, np.int64)
        least = int(need[able].min())
        length = self.length[code]
        order = np.argsort(length, kind="stable")
        # Lists set aside: the heuristic T / (mu log M + 1), T - 1 at most.
        aside = max(0, min(least - 1, int(least / (0.01 * math.log(int(length[order[-1]]) + 1) + 1))))
        short, long = code[order[: len(code) - aside]], code[order[len(code) - aside :]]
        merged = [(y, n) for y, n in merge_skip([self.lists[c] for c in short.tolist()], least - aside) if able[y]]
        found = [y for y, n in merged if n + self._held(y, long, int(need[y]) - n) >= need[y]]
        return np.array(found, np.int64)

    def _held(self, y: int, long: np.ndarray, wanted: int) -> int:
        """In how many of the long lists y is."""
        if wanted <= 0 or wanted > len(long):
            return 0
        own = self.code[y]
        if len(own) < 8 * len(long):
            return int((own[np.minimum(np.searchsorted(own, long), len(own) - 1)] == long).sum())
        have = 0
        for k, c in enumerate(long.tolist()):
            own_list = self.lists[c]
            i = bisect_left(own_list, y)
            have += i < len(own_list) and own_list[i] == y
            if have + len(long) - k - 1 < wanted:
                break
        return have


def search_links(reps: list[int], sets: list[np.ndarray], percent: int, parts: list[int] | None = None, seeds: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links that, with those that made ``parts`` (components known before),
    span the components among ``sets``. From each set, or each of ``seeds``,
    only sets not yet in its component are searched for, which loses none."""
    n = len(sets)
    searcher, links, sets_of = Searcher(sets), [], UnionFind()
    root = np.unique(parts, return_inverse=True)[1] if parts else np.arange(n)
    ask, todo = np.array(seeds if seeds else [True] * n), np.ones(n, bool)
    for x in np.argsort(-searcher.size, kind="stable"):
        if not ask[x]:
            continue
        todo[x] = False
        others = (root != root[x]) & (todo | ~ask)
        if not others.any():
            continue
        for y in searcher.overlaps(x, percent, others):
            if sets_of.join(int(root[x]), int(root[y])):
                links.append((reps[x], reps[y]))
                a, b = root[x], root[y]
                root[(root == a) | (root == b)] = min(a, b)
    return links


def _search(percent: int):
    """For rows sorted by task and rep: a task's links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reps, sets, parts, seeds = None, [], [], [], []

        def out() -> pa.RecordBatch:
            links = search_links(reps, sets, percent, parts, seeds) if len(reps) > 1 else []
            a, b = zip(*links) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for root, i, j, rep, part, seed, raw in zip(*(c.to_pylist() if k < 6 else c for k, c in enumerate(batch.columns))):
                if (root, i, j) != now:
                    if now is not None:
                        yield out()
                    now, reps, sets, parts, seeds = (root, i, j), [], [], [], []
                if reps and reps[-1] == rep:
                    seeds[-1] |= seed  # the same set once more
                    continue
                reps.append(rep)
                sets.append(np.frombuffer(raw.as_buffer(), "<u8"))
                parts.append(part)
                seeds.append(seed)
        if now is not None:
            yield out()

    return run


def _blocks(member: DataFrame, root: str = "root") -> DataFrame:
    """``root, blocks``: how many blocks a cluster's sets fill."""
    return member.groupBy(root).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))


def _run_tasks(tasks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``tasks``: root, i, j, rep, part, seed. Few of them are sent to the sets
    instead of sorting all sets to them."""
    tasks = materialize(tasks, "tasks")
    tasks = F.broadcast(tasks) if tasks.count() <= FEW_TASKS else tasks.hint("merge")
    work = tasks.join(sets, "rep").select("root", "i", "j", "rep", "part", "seed", "hashes")
    return work.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "rep").mapInArrow(tidy(_search(percent)), "a long, b long")


def cluster_links(clusters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b``: links that span the components of every cluster (``node,
    root``). ``sets``: rep, hashes."""
    member = clusters.select("root", F.col("node").alias("rep"))
    sized = member.join(_blocks(member), "root")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    # Each block by itself, and with some sets of its cluster that all meet.
    own = sized.select("root", block.alias("i"), F.lit(0).alias("j"), "rep")
    large = sized.where("blocks > 1")
    pivot = large.withColumn("_k", F.row_number().over(Window.partitionBy("root").orderBy(F.xxhash64("rep", F.lit(1)), "rep"))).where(F.col("_k") <= PIVOTS)
    shared = pivot.select("root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.lit(0).alias("j"), "rep")
    every = own.unionByName(shared).select("*", F.col("rep").alias("part"), F.lit(True).alias("seed"))
    first = materialize(_run_tasks(every, sets, percent), "links")
    if large.isEmpty():
        return first
    # Large clusters of several components are dealt anew by stricter keys.
    parts = components(first).select(F.col("node").alias("rep"), F.col("root").alias("part"))
    known = materialize(large.join(parts, "rep", "left").select("root", "rep", F.coalesce("part", "rep").alias("part")), "parts")
    # Where few rows would be searched as they are, dealing anew costs more.
    per = known.groupBy("root", "part").count().groupBy("root").agg(F.sum("count").alias("n"), (F.sum("count") - F.max("count")).alias("rest"))
    rows = per.where("rest > 0").agg(F.sum(F.col("rest") * F.ceil(F.col("n") / BLOCK) + F.col("n") * F.ceil(F.col("rest") / BLOCK))).first()[0] or 0
    if rows > FEW_TASKS:
        mixed = per.where("rest > 0").select("root")
        close = _finer(known.join(mixed, "root").select("rep").join(sets.hint("merge"), "rep"), percent)
        known = known.drop("root").join(close.withColumnRenamed("node", "rep"), "rep")
    elif not rows:
        return first
    known = materialize(known.join(_blocks(known), "root"), "parts")
    # What the cluster's largest component does not hold meets all the rest.
    most = known.groupBy("root", "part").count().groupBy("root").agg(F.max(F.struct("count", "part")).getField("part").alias("most"))
    known = known.join(most, "root")
    rest = known.where("part <> most")
    rest_blocks = _blocks(rest).withColumnRenamed("blocks", "rests")
    rest = rest.join(rest_blocks, "root")
    asked = rest.select("root", F.pmod(F.xxhash64("rep", F.lit(2)), F.col("rests")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "rep", "part", F.lit(True).alias("seed"))
    met = known.join(rest_blocks, "root").select("root", F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("i"), block.alias("j"), "rep", "part", F.lit(False).alias("seed"))
    return first.unionByName(_run_tasks(asked.unionByName(met), sets, percent))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id`` of every document; the component is
    named by its smallest id. Two documents link where 100 * intersection is
    ``percent`` * union or more."""
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).where("id is not null")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(1, math.ceil(size * _slice_of(percent) / 6 / PART_SHINGLES))
    found = materialize(set_rows(source, words), "set-rows")
    found = found.groupBy("id").agg(F.min(F.struct("h", "h2", "n")).alias("s")).select("id", "s.n", "s.h", "s.h2")
    classes = materialize(found.where("n > 0").groupBy("n", "h", "h2").agg(F.min("id").alias("rep")), "classes")

    lone = lone_shingles(source, words, percent, n_parts)
    allowed = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / F.lit(100))
    alive = classes.join(lone, "h", "left").where(F.coalesce("lone", F.lit(0)) <= allowed)
    alive = materialize(alive.select("rep", F.col("h").alias("want"), F.col("h2").alias("want2")), "alive")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, flat, off, h, h2 in _sets(batch.column(1), words):
                s = slice(chunk.first, chunk.first + len(chunk))
                rows = pa.RecordBatch.from_arrays([batch.column(0)[s], binary_rows(flat, off)], ["rep", "hashes"])
                yield rows.filter(pa.array((h == batch.column(2)[s].to_numpy()) & (h2 == batch.column(3)[s].to_numpy())))

    # What is alive grows with the corpus, so it is merged, never broadcast.
    sets = source.join(alive.hint("merge"), source.id == alive.rep).select("id", "text", "want", "want2").mapInArrow(tidy(make), "rep long, hashes binary")
    sets = materialize(sets, "sets")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.frombuffer(x.as_buffer(), "<u8") for x in batch.column(1)]
            rep = batch.column(0).to_numpy()
            for lo in range(0, len(raw), 256):
                some = raw[lo : lo + 256]
                k, owner = part_keys(np.concatenate(some), np.cumsum([0, *map(len, some)]), percent)
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(np.zeros(len(k), bool)), pa.array(rep[lo + owner])], ["key", "less", "rep"])

    keyed = sets.select("rep", "hashes").mapInArrow(tidy(keys), "key long, less boolean, rep long")
    clusters = _clusters(keyed)

    links = cluster_links(clusters, sets, percent)
    joined = components(links)
    for done in (alive, sets, clusters):
        forget(done)

    named = classes.join(joined, F.col("rep") == F.col("node"), "left").select("n", "h", "h2", F.coalesce("root", "rep").alias("component_id"))
    named = materialize(named, "named")  # so that a class of many copies can be split in the join
    return found.join(named, ["n", "h", "h2"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id")
    )


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component: one
    row of each group of near duplicates, that of the smallest id (nulls last).
    Rows are compared one by one: repeated rows are near duplicates, rows of one
    id that are unlike are not, and ids may be of any type. Rows without words
    all stay."""
    row = "_thicket_row"
    while row in docs.columns:
        row += "_"
    # A row's number holds only once it is written.
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = near_duplicates(rows, words, percent, row, text).where("n_shingles > 0").join(rows.select(row, F.col(f"`{id_col}`").alias("_id")), row)
    best = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", row))
    kept = groups.groupBy("component_id").agg(best.getField(row).alias("_one")).select("_one")
    gone = groups.select(F.col(row).alias("_gone")).join(kept, F.col("_gone") == F.col("_one"), "left_anti")
    return rows.join(gone, F.col(row) == F.col("_gone"), "left_anti").drop(row)
