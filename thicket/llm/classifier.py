"""Quality classifier: logistic regression over hashed word n-grams.

Features are unigrams and bigrams of words and of word shapes (runs of letters
by case, digits and signs), and whether neighbouring words are the same, all
hashed into ``2 ** bits`` weights. Training is follow-the-regularised-leader
(proximal, per-coordinate rates, L1 and L2) in one task over at most
``train_docs`` labelled documents, those of the smallest hash; the weights are
a vector of fixed length, so broadcasting them is bounded. Scoring every text
is a narrow pass of sparse dot products.

Null and empty texts have no feature and score by the bias alone. Labels that
are null are not used. Without any label every score is 0.5. Rows repeat as
they come.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.llm._words import Chunk, Words, chunks, mix64, segment_hash, tidy

BITS = 18
TRAIN_DOCS = 8_000
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 1.0
EPOCHS = 2

_U = np.uint64
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = ord("A")
_SHAPE[97:123] = ord("a")
_SHAPE[128:] = ord("a")
_SHAPE[48:58] = ord("0")


def features(chunk: Chunk, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all rows, with repeats, and offsets of rows."""
    w = Words(chunk, lower=True)
    n = len(w.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(chunk) + 1, np.int64)
    kind = _SHAPE[chunk.buf]
    turn = np.ones(len(kind), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[w.start] = True
    turns = np.concatenate([[0], np.cumsum(turn)])
    shape = segment_hash(kind[turn], turns[w.start], turns[w.end] - turns[w.start])
    last = np.zeros(n, bool)
    last[w.off[1:][w.off[1:] > w.off[:-1]] - 1] = True
    nxt = np.minimum(np.arange(n) + 1, n - 1)
    same = np.where(w.hash == w.hash[nxt], _U(3), _U(4))
    pair = mix64(w.hash * _U(0xA0761D6478BD642F) + w.hash[nxt])
    shapes = mix64(shape * _U(0xE7037ED1A0B428DB) + shape[nxt])
    single = [mix64(w.hash + _U(1)), mix64(shape + _U(2))]
    double = [np.where(last, single[0], mix64(pair + _U(5))), np.where(last, single[1], mix64(shapes + _U(6))), mix64(np.where(last, _U(7), same))]
    grid = np.stack([*single, *double], axis=1)
    return (grid.ravel() >> _U(64 - bits)).astype(np.int64), w.off * 5


def row_values(idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of one row and their L2-normalised counts."""
    f, c = np.unique(idx, return_counts=True)
    return f, c / np.sqrt((c.astype(float) ** 2).sum()) if len(c) else c.astype(float)


class Ftrl:
    """FTRL-proximal; the bias is one more weight, at the end."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, f: np.ndarray, x: np.ndarray, y: int) -> None:
        f, x = np.append(f, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(f)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        sigma = (np.sqrt(self.n[f] + g * g) - np.sqrt(self.n[f])) / ALPHA
        self.z[f] += g - sigma * w
        self.n[f] += g * g


def train(docs: DataFrame, labels: DataFrame, where: Column, label: str = "quality", id_col: str = "doc_id", text: str = "text", train_docs: int = TRAIN_DOCS, bits: int = BITS) -> np.ndarray:
    """Weights from the labelled documents for which ``where`` (of ``id_col``)
    holds: the ``train_docs`` of smallest hash, each id once (of rows that share
    an id, the one whose features sort first). Ids may be of any type."""
    picked = (
        labels.where(where & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(train_docs)
    )
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(picked), "_id")  # train_docs rows

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                idx, off = features(chunk, bits)
                fs, xs = [], []
                for i in range(len(chunk)):
                    f, x = row_values(idx[off[i] : off[i + 1]])
                    fs.append(f.astype("<u4").tobytes())
                    xs.append(x.astype("<f4").tobytes())
                s = slice(chunk.first, chunk.first + len(chunk))
                yield pa.RecordBatch.from_arrays([batch.column(0)[s], batch.column(2)[s], pa.array(fs, pa.binary()), pa.array(xs, pa.binary())], ["k", "y", "f", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = Ftrl(1 << bits), {}
        for batch in batches:
            for k, y, f, x in zip(*(c.to_pylist() for c in batch.columns)):
                seen.setdefault(k, (np.frombuffer(f, "<u4"), np.frombuffer(x, "<f4"), y))
        for _ in range(EPOCHS):
            for f, x, y in seen.values():
                model.learn(f, x, y)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights(slice(None)).astype("<f4").tobytes()], pa.binary())], ["w"])

    kind = dict(rows.dtypes)["_id"]
    found = rows.select("_id", "_text", F.col("_y").cast("int")).mapInArrow(tidy(extract), f"k {kind}, y int, f binary, x binary")
    one = found.repartition(1).sortWithinPartitions(F.xxhash64("k"), "k", "f").mapInArrow(tidy(learn), "w binary").collect()
    return np.frombuffer(one[0].w, "<f4") if one else np.zeros((1 << bits) + 1, "<f4")


def chunk_scores(chunk: Chunk, weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    idx, off = features(chunk, bits)
    n = len(chunk)
    out = np.full(n, float(weights[-1]))
    if len(idx):
        # Counts of a row's features come from sorting (row, feature) keys.
        key = np.repeat(np.arange(n) << bits, np.diff(off)) | idx
        key.sort()
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        c = np.diff(np.append(first, len(key))).astype(float)
        row = key[first] >> bits
        dot = np.bincount(row, c * weights[key[first] & ((1 << bits) - 1)], n)
        out += dot / np.sqrt(np.maximum(np.bincount(row, c * c, n), 1))
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", keep: Sequence[str] = ("doc_id",), bits: int = BITS) -> DataFrame:
    """``keep`` columns and ``score``, the probability of label 1."""
    keep = list(keep)
    kinds = dict(docs.dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 4 bytes a weight

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(len(keep))):
                cols = [batch.column(i).slice(chunk.first, len(chunk)) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(chunk_scores(chunk, shared.value, bits))], [*keep, "score"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "score double"])
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`")).mapInArrow(tidy(run), schema)


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float, text: str = "text", bits: int = BITS) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more."""
    shared, at = docs.sparkSession.sparkContext.broadcast(weights), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = [chunk_scores(chunk, shared.value, bits) >= threshold for chunk in chunks(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(mask) if mask else np.zeros(0, bool)))

    return docs.mapInArrow(tidy(run), docs.schema)
