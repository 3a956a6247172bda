"""Packing by lexical retrieval.

Documents become token ids once, in a table in the shared folder, together with
each token's document frequency over the whole corpus (at most one row a token
of the vocabulary, so collecting it is bounded). Then they are dealt by content:
tokens are put in a few random orders in which rare ones tend to come first (the
chance is the square of their idf), and a document's key is its first token in
each. Two documents agree in one with the probability of their weighted overlap,
so in the order of keys over the whole corpus copies are neighbours and like
texts are near. Blocks of consecutive documents in that order are the shards,
bounded in documents and in tokens: each holds a BM25 inverted index, a list a
term of the documents that have it and their weights. A seed document opens a
window; the lists of its terms give the scores of its neighbours, and the best
unused ones fill the window; the one that does not fit is cut, and its rest seeds
the next window. Lists lose used documents whenever these are half of all. A
window left open at a shard's end is filled from the next shard of the task, so a
task pads one window at most. Token ids are shuffled once. Neighbours are scored
within a shard, so one that the keys did not bring near is not reached; README
has the share.

Null texts are empty documents: they hold their end id alone. Repeated rows are
documents of their own. A document longer than a window fills windows of its
own first; its rest is packed with others. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm._vocab import library_encoder
from thicket.llm._words import chunks, mix64, tidy
from thicket.llm.bpe import binary_rows
from thicket.storage import materialize

WINDOW = 2048
SHARD_DOCS, SHARD_TOKENS = 2048, 1 << 21  # a shard ends at either
K1, B = 1.2, 0.75


def append_end(ids: np.ndarray, rows: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows with an end id after each, and their offsets."""
    n = len(rows) - 1
    out = np.full(len(ids) + n, end_id, ids.dtype)
    keep = np.ones(len(out), bool)
    rows = rows + np.arange(n + 1)
    keep[rows[1:] - 1] = False
    out[keep] = ids
    return out, rows


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of documents (``ids``) and, with a ``term``, of document
    frequencies ``n`` that a task has counted; term -1 counts ids."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, df, total, schema = library_encoder(tokenizer_path), np.zeros(1 << 16, np.int64), 0, None
        for batch in batches:
            schema = batch.schema
            for chunk in chunks(batch.column(1)):
                ids, rows, _ = encoder.encode(chunk)
                ids, rows = append_end(ids, rows, end_id)
                if len(ids) and ids.max() >= len(df):
                    df = np.concatenate([df, np.zeros(int(ids.max()) + 1 - len(df), np.int64)])
                total += len(ids)
                doc = np.repeat(np.arange(len(chunk)), np.diff(rows))
                for lo in range(0, len(chunk), 64):
                    a, b = rows[lo], rows[min(lo + 64, len(chunk))]
                    seen = np.zeros((64, len(df)), bool)
                    seen[doc[a:b] - lo, ids[a:b]] = True
                    df += seen.sum(0)
                n = len(chunk)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.first, n), binary_rows(ids.astype("<u4" if len(df) > 1 << 16 else "<u2"), rows), pa.nulls(n, pa.int64()), pa.array(np.diff(rows))],
                    ["id", "ids", "term", "n"],
                )
        if schema is not None:
            terms = np.flatnonzero(df)
            n = len(terms) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, schema.field(0).type), pa.nulls(n, pa.binary()), pa.array(np.append(terms, -1)), pa.array(np.append(df[terms], total))], ["id", "ids", "term", "n"]
            )

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text}`")).mapInArrow(tidy(run), f"id {kind}, ids binary, term long, n long")


class InvertedIndex:
    """BM25 index of a shard: a list a term, and each document's terms. Terms in
    an eighth of the documents or more have their weights in every document, so
    that their lists are added whole; the others list documents and weights."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        size = np.array([len(x) for x in docs])
        self.n = len(docs)
        key = np.concatenate(docs).astype(np.int64) * self.n + np.repeat(np.arange(self.n), size)
        key, tf = np.unique(key, return_counts=True)
        token, doc = key // self.n, key % self.n
        weight = idf[token] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / max(mean, 1.0)))
        term = np.cumsum(np.append(False, token[1:] != token[:-1])) if len(token) else token
        self._arrange(doc.astype(np.int32), weight.astype(np.float32), term.astype(np.int32))

    def _arrange(self, doc: np.ndarray, weight: np.ndarray, term: np.ndarray) -> None:
        order = np.argsort(doc, kind="stable")
        self.terms_of, self.first = term[order], np.searchsorted(doc[order], np.arange(self.n + 1))
        begin = np.searchsorted(term, np.arange(int(term[-1]) + 2 if len(term) else 1))
        often = np.diff(begin) * 8 >= len(np.unique(doc))
        self.dense = np.full(len(often), -1)
        self.dense[often] = np.arange(often.sum())
        self.rows = np.zeros((int(often.sum()), self.n), np.float32)
        own = often[term]
        self.rows[self.dense[term[own]], doc[own]] = weight[own]
        self.doc, self.weight, self.term, self.begin = doc, weight, term, begin

    def keep(self, some: np.ndarray) -> None:
        """Leaves only the documents of a mask in the lists."""
        mask = some[self.doc]
        self._arrange(self.doc[mask], self.weight[mask], self.term[mask])

    def scores(self, seed: int) -> np.ndarray:
        """Of all documents against the distinct terms of one."""
        terms = self.terms_of[self.first[seed] : self.first[seed + 1]]
        row = self.dense[terms]
        terms = terms[row < 0]
        at, n = self.begin[terms], self.begin[terms + 1] - self.begin[terms]
        every = np.arange(n.sum()) + np.repeat(at - (np.cumsum(n) - n), n)
        out = np.bincount(self.doc[every], self.weight[every], self.n)
        return out + np.add.reduce(self.rows[row[row >= 0]], axis=0)

    def ranked(self, seed: int, among: np.ndarray) -> Iterator[int]:
        """The documents of a mask by score, ties in the order of the shard."""
        own = np.flatnonzero(among)
        score = self.scores(seed)[own]
        best = np.arange(len(own))
        if len(own) > 256:  # these do as a rule
            best = np.flatnonzero(score >= np.partition(score, -64)[-64])
        yield from own[best[np.argsort(-score[best], kind="stable")]]
        if len(best) < len(own):
            rest = np.setdiff1d(np.arange(len(own)), best)
            yield from own[rest[np.argsort(-score[rest], kind="stable")]]


class WindowPacker:
    """Fills windows; the open one stays open across the shards of a task."""

    def __init__(self, window: int, first_id: int):
        self.window, self.next_id, self.open_id, self.used = window, first_id, -1, 0

    def shard(self, docs: list[np.ndarray], idf: np.ndarray, mean: float) -> list[tuple[int, int, int, int, int]]:
        """Pieces of a shard: document, start, length, sequence, offset."""
        out = []
        size = np.array([len(x) for x in docs])
        at = size // self.window * self.window
        for i in np.flatnonzero(at):
            for start in range(0, at[i], self.window):
                out.append((i, start, self.window, self.next_id, 0))
                self.next_id += 1

        def put(i: int) -> bool:
            """Place what fits of a rest; whether the window is full."""
            if self.open_id < 0:
                self.open_id, self.used, self.next_id = self.next_id, 0, self.next_id + 1
            n = min(size[i] - at[i], self.window - self.used)
            out.append((i, at[i], n, self.open_id, self.used))
            at[i] += n
            self.used += n
            free[i] = at[i] < size[i]
            if self.used == self.window:
                self.open_id = -1
            return self.open_id < 0

        free = at < size
        index = InvertedIndex(docs, idf, mean) if free.sum() > 1 else None
        seed, listed = -1, len(docs)
        while n_free := int(free.sum()):
            if 2 * n_free <= listed and n_free > 16:
                index.keep(free)
                listed = n_free
            if seed < 0 or not free[seed]:
                seed = int(np.argmax(free))
            if not put(seed) and free.any():
                for i in index.ranked(seed, free):
                    if put(i):
                        seed = i  # what is left of it comes next
                        break
        return out


def content_orders(idf: np.ndarray) -> tuple[np.ndarray, int]:
    """Places of all tokens in each random order, and the bits a place takes."""
    bits = max(16, (len(idf) - 1).bit_length())
    token, weight = np.arange(len(idf), dtype=np.uint64), np.maximum(idf, 1e-9) ** 2
    out = np.empty((64 // bits, len(idf)), np.int64)
    for k, row in enumerate(out):
        u = ((mix64(token ^ mix64(np.full(1, k + 1, np.uint64))) >> np.uint64(11)) + 1.0) / 2.0**53
        row[np.argsort(-np.log(u) / weight, kind="stable")] = np.arange(len(idf))
    return out, bits


def content_keys(ids: np.ndarray, rows: np.ndarray, orders: np.ndarray, bits: int) -> np.ndarray:
    """A key for each document; none may be without ids."""
    key = np.zeros(len(rows) - 1, np.uint64)
    for order in orders:
        key = (key << np.uint64(bits)) | np.minimum.reduceat(order[ids], rows[:-1]).astype(np.uint64)
    return (key ^ np.uint64(1 << 63)).view(np.int64)  # signed values in the same order


def _deal(tokens: DataFrame, idf: np.ndarray) -> DataFrame:
    """``id`` and ``ids`` of all documents, partitions and rows in the order of content."""
    kind = dict(tokens.dtypes)["id"]
    shared = tokens.sparkSession.sparkContext.broadcast(idf)  # as long as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, bits = content_orders(shared.value)
        width = "<u4" if len(shared.value) > 1 << 16 else "<u2"
        for batch in batches:
            raw, keys = [np.frombuffer(x.as_buffer(), width) for x in batch.column(1)], []
            for lo in range(0, len(raw), 256):
                some = raw[lo : lo + 256]
                keys.append(content_keys(np.concatenate(some), np.cumsum([0, *map(len, some)]), orders, bits))
            if keys:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(keys))], ["id", "ids", "key"])

    keyed = tokens.where(F.col("ids").isNotNull()).select("id", "ids").mapInArrow(tidy(run), f"id {kind}, ids binary, key long")
    # The row number parts large groups of copies among tasks.
    order = ["key", "same", "row"]
    keyed = keyed.withColumn("same", F.xxhash64("ids")).withColumn("row", F.monotonically_increasing_id())
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "ids")


def _pack(tokens: DataFrame, idf: np.ndarray, mean: float, id_col: str, window: int, shard_docs: int) -> DataFrame:
    kind = dict(tokens.dtypes)["id"]
    shared = tokens.sparkSession.sparkContext.broadcast(idf)  # as long as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = WindowPacker(window, TaskContext.get().partitionId() << 36)
        names: list = []
        docs: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            pieces = packer.shard(docs, shared.value, mean)
            doc, start, length, seq, offset = (np.array(x, np.int64) for x in zip(*pieces))
            flat = np.concatenate([docs[d][s : s + n] for d, s, n, _, _ in pieces]).astype("<u4")
            total = np.array([len(x) for x in docs])[doc]
            ids = binary_rows(flat, np.concatenate([[0], np.cumsum(length)]))
            column = pa.concat_arrays(names).take(pa.array(doc))
            return pa.RecordBatch.from_arrays([column, pa.array(start), pa.array(length), ids, pa.array(total), pa.array(seq), pa.array(offset)], [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            width = "<u4" if len(shared.value) > 1 << 16 else "<u2"
            for i, x in enumerate(batch.column(1)):
                docs.append(np.frombuffer(x.as_py(), width))
                names.append(batch.column(0).slice(i, 1))
                held += len(docs[-1])
                if len(docs) >= shard_docs or held >= SHARD_TOKENS:
                    yield flush()
                    names.clear()
                    docs.clear()
                    held = 0
        if docs:
            yield flush()

    return tokens.mapInArrow(
        tidy(run), f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text: str = "text", window: int = WINDOW, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per piece: ``id_col, start, length, ids`` (binary, unsigned 32
    bit), ``doc_tokens, sequence_id, offset``."""
    table = materialize(tokenize(docs, tokenizer_path, end_id, id_col, text), "tokens")
    counts = table.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row a token of the vocabulary
    n_docs = table.where(F.col("ids").isNotNull()).count()
    df = np.zeros(max(1 << 16, 1 + max((r.term for r in counts), default=0)))
    total = 0
    for r in counts:
        if r.term < 0:
            total = r.n
        else:
            df[r.term] = r.n
    idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
    return _pack(_deal(table, idf), idf, total / max(n_docs, 1), id_col, window, shard_docs)
