"""Byte-level BPE encoding and decoding of whole texts.

``encode`` finds pre-token boundaries with the array scan of ``_pretok``, then
looks slices up in a bounded cache that pair merging fills. Ids and the byte
offsets of slices are kept as binary columns (little-endian unsigned 32 bit),
so a row costs four bytes a token. ``decode`` gives the bytes of whole documents
back, and ``decode_slices``, by the offsets, those of ranges of slices.

Both are narrow: no shuffle, one pass, memory bounded by a chunk of text or one
document. Null texts are empty: they have no ids and decode to no bytes. Rows
repeat as they come; other columns than ``keep`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.llm._vocab import rank_encoder, vocabulary_bytes
from thicket.llm._words import chunks, tidy


def binary_rows(flat: np.ndarray, off: np.ndarray) -> pa.Array:
    """Rows of a flat array, as a binary column without copies per row."""
    flat = np.ascontiguousarray(flat)
    at = np.asarray(off, np.int64) * flat.itemsize
    if at[-1] < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(flat)])
    raw = flat.tobytes()
    return pa.array([raw[a:b] for a, b in zip(at, at[1:])], pa.binary())


def _out_schema(df: DataFrame, keep: Sequence[str], more: str) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), more])


def encode(docs: DataFrame, ranks_path: str, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``ids`` and ``starts`` (byte offset of each slice)."""
    keep = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(ranks_path)
        for batch in batches:
            for chunk in chunks(batch.column(len(keep))):
                ids, rows, start = encoder.encode(chunk)
                j = np.searchsorted(start, chunk.off)
                local = start - np.repeat(chunk.off[:-1], np.diff(j))
                cols = [batch.column(i).slice(chunk.first, len(chunk)) for i in range(len(keep))]
                cols += [binary_rows(ids.astype("<u4"), rows), binary_rows(local.astype("<u4"), j)]
                yield pa.RecordBatch.from_arrays(cols, [*keep, "ids", "starts"])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`")).mapInArrow(tidy(run), _out_schema(docs, keep, "ids binary, starts binary"))


def decode(encoded: DataFrame, ranks_path: str, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``ids`` as they are and the decoded ``bytes``."""
    keep = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, at = vocabulary_bytes(ranks_path)
        for batch in batches:
            step = max(1, int(batch.num_rows * (1 << 22) / max(batch.nbytes, 1)))
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                column = part.column(len(keep)).cast(pa.large_binary()).fill_null(b"")
                _, off, data = column.buffers()
                rows = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] // 4
                ids = np.frombuffer(data, "<u4")[rows[0] : rows[-1]] if data is not None and data.size else np.zeros(0, "<u4")
                begin, size = at[ids], np.diff(at)[ids]
                end = np.concatenate([[0], np.cumsum(size)])
                out = flat[np.arange(end[-1]) + np.repeat(begin - end[:-1], size)]
                cols = [part.column(i) for i in range(len(keep))] + [part.column(len(keep)), binary_rows(out, end[rows - rows[0]])]
                yield pa.RecordBatch.from_arrays(cols, [*keep, "ids", "bytes"])

    return encoded.select(*[F.col(f"`{c}`") for c in keep], "ids").mapInArrow(tidy(run), _out_schema(encoded, keep, "ids binary, bytes binary"))


def decode_slices(encoded: DataFrame, ranks_path: str, first: Column, count: Column, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``bytes`` of ``count`` slices from ``first`` (from 0)
    on, as many as there are. No token reaches over a slice's end, so offsets of
    slices are offsets of tokens, and only the tokens in between are decoded."""
    keep = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, at = vocabulary_bytes(ranks_path)
        size = np.diff(at)
        for batch in batches:
            out = []
            for raw, offsets, a, n in zip(*(batch.column(len(keep) + i).to_pylist() for i in range(4))):
                ids, starts = np.frombuffer(raw or b"", "<u4"), np.frombuffer(offsets or b"", "<u4")
                a = min(max(a or 0, 0), len(starts))
                b = min(a + max(n or 0, 0), len(starts))
                begin = np.cumsum(size[ids]) - size[ids]
                some = slice(*(int(np.searchsorted(begin, starts[k])) if k < len(starts) else len(ids) for k in (a, b)))
                out.append(b"".join(flat[at[i] : at[i + 1]].tobytes() for i in ids[some].tolist()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(out, pa.binary())], [*keep, "bytes"])

    rows = encoded.select(*[F.col(f"`{c}`") for c in keep], "ids", "starts", first.cast("int").alias("_first"), count.cast("int").alias("_count"))
    return rows.mapInArrow(tidy(run), _out_schema(encoded, keep, "bytes binary"))
