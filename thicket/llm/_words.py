"""Vectorised words over Arrow text columns: no Python object per word.

A column is read in chunks of about half a megabyte of UTF-8. Words are maximal
runs of ``[^\\x20\\x09-\\x0D]``; each gets a 64-bit hash computed by numpy from
its bytes, so that memory is bounded by the chunk (or by one document, if that
is longer) whatever the table holds.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

CHUNK_BYTES = 1 << 19

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_U = np.uint64


MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_HUGE = 4096


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(29))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


#: Rows of a batch between the JVM and Python; bytes as well where Spark heeds it.
BATCH_ROWS, BATCH_BYTES = 2000, "16m"


def release() -> None:
    """Give freed memory back to the system: a worker lives on after a task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def small_batches(spark: SparkSession) -> None:
    """Short Arrow batches for the whole session, as texts may be long. The
    registered queries ask for it; a caller of the operators may do so too."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def tidy(run: Batches) -> Batches:
    """A function for ``mapInArrow`` that keeps workers small: what a batch has
    freed goes back to the system before the next."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                release()

        yield from run(each())

    return tidied


class Chunk:
    """Consecutive rows of a column: UTF-8 bytes and row offsets into them."""

    __slots__ = ("first", "buf", "off")

    def __init__(self, first: int, buf: np.ndarray, off: np.ndarray):
        self.first, self.buf, self.off = first, buf, off

    def __len__(self) -> int:
        return len(self.off) - 1

    def text(self, i: int) -> bytes:
        return self.buf[self.off[i] : self.off[i + 1]].tobytes()


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offsets


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a column into chunks of at most ``limit`` bytes or one row."""
    buf, off = column_bytes(col)
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield Chunk(i, buf[off[i] : off[j]], off[i : j + 1] - off[i])
        i = j


def words8(buf: np.ndarray) -> np.ndarray:
    """Eight bytes from every position on, as one number; zeros beyond the end."""
    pad = np.zeros(len(buf) + 8, np.uint8)
    pad[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", pad, 0, (1,))


#: Two lanes of hashes that share no constant. Where a single one would decide,
#: bytes are compared or both lanes are used.
_SIZE = [_U(0xD6E8FEB86659FD93), _U(0xA5CB9243F3D2E6B5)]
_SEED = [_U(0x2127599BF4325C37), _U(0x880355F21E6D1965)]
_BLOCK = [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)]


def segment_hash(buf: np.ndarray, start: np.ndarray, size: np.ndarray, lane: int = 0, view: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of byte segments, eight bytes at a step for all at once."""
    view = words8(buf) if view is None else view
    sized = mix64(size.astype(np.uint64) * _SIZE[lane] + _SEED[lane])
    first = view[start] & MASK[np.minimum(size, 8)]
    h = mix64((first * _BLOCK[lane] if lane else first) ^ sized)
    more, k = np.flatnonzero((size > 8) & (size <= _HUGE)), 8
    while len(more):
        w = view[start[more] + k] & MASK[np.minimum(size[more] - k, 8)]
        h[more] = mix64((h[more] ^ w) * _BLOCK[lane] + sized[more])
        k += 8
        more = more[size[more] > k]
    for i in np.flatnonzero(size > _HUGE):
        raw = buf[start[i] : start[i] + size[i]].tobytes()
        h[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8, salt=bytes([lane])).digest(), "little")
    return h


def same_segments(view: np.ndarray, start: np.ndarray, other: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether segments of equal size hold the same bytes (``words8`` of each)."""
    same = ((view[start] ^ other[at]) & MASK[np.minimum(size, 8)]) == 0
    more, k = np.flatnonzero(same & (size > 8)), 8
    while len(more):
        same[more] = ((view[start[more] + k] ^ other[at[more] + k]) & MASK[np.minimum(size[more] - k, 8)]) == 0
        k += 8
        more = more[same[more] & (size[more] > k)]
    return same


def exact_codes(buf: np.ndarray, start: np.ndarray, size: np.ndarray, h: np.ndarray | None = None) -> np.ndarray:
    """Numbers from 0 that are equal exactly where the bytes are."""
    view = words8(buf)
    h = segment_hash(buf, start, size, view=view) if h is None else h
    _, first, code = np.unique(h, return_index=True, return_inverse=True)
    own = first[code]
    if (size == size[own]).all() and same_segments(view, start, view, start[own], size).all():
        return code
    raw, table = buf.tobytes(), {}
    return np.array([table.setdefault(raw[a:b], len(table)) for a, b in zip(start.tolist(), (start + size).tolist())])


class Words:
    """Words of a chunk: byte spans, word offsets per row and hashes (``hash``
    and, made when asked for, a second lane)."""

    __slots__ = ("start", "end", "off", "flat", "_lanes")

    def __init__(self, chunk: Chunk, lower: bool = False):
        buf, off = chunk.buf, chunk.off
        n = len(buf)
        self._lanes: list[np.ndarray | None] = [None, None]
        self.flat = buf
        if not n:
            self.start = self.end = np.zeros(0, np.int64)
            self.off = np.zeros(len(off), np.int64)
            return
        inside = ~SPACE[buf]
        edge = np.empty(n, bool)
        edge[0] = True
        np.logical_not(inside[:-1], out=edge[1:])
        edge[off[:-1][off[:-1] < n]] = True
        self.start = np.flatnonzero(inside & edge)
        edge[-1] = True
        np.logical_not(inside[1:], out=edge[:-1])
        edge[off[1:][off[1:] > 0] - 1] = True
        self.end = np.flatnonzero(inside & edge) + 1
        if lower:
            self.flat = np.frombuffer(buf.tobytes().lower(), np.uint8)  # bytes.lower() is A-Z only
        self.off = np.searchsorted(self.start, off)

    def lane(self, i: int) -> np.ndarray:
        if self._lanes[i] is None:
            self._lanes[i] = segment_hash(self.flat, self.start, self.end - self.start, i)
        return self._lanes[i]

    @property
    def hash(self) -> np.ndarray:
        return self.lane(0)

    def codes(self) -> np.ndarray:
        """``exact_codes`` of the words."""
        return exact_codes(self.flat, self.start, self.end - self.start, self.hash)

    def counts(self) -> np.ndarray:
        return np.diff(self.off)


_STEP = [
    [_U(x | 1) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)],
    [_U(x | 1) for x in (0xF1357AEA2E62A9C5, 0x9FB21C651E98DF25, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0xB564EF22EC7AECE5)],
]


def _windows(h: np.ndarray, off: np.ndarray, n: int, step: list) -> tuple[np.ndarray, np.ndarray]:
    count = np.diff(off)
    full = mix64(h * step[0])
    for k in range(1, n):
        full[:-k] = mix64(full[:-k] + h[k:] * step[k % 5]) if k < len(h) else full[:-k]
    make = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out_off = np.concatenate([[0], np.cumsum(make)])
    at = np.arange(out_off[-1]) - np.repeat(out_off[:-1] - off[:-1], make)
    out = full[at]
    for i in np.flatnonzero((count > 0) & (count < n)):
        x = np.full(1, count[i], np.uint64)
        for w in h[off[i] : off[i + 1]]:
            x = mix64(x * step[1] + w)
        out[out_off[i]] = x[0]
    return out, out_off


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows, and their offsets per row. A row with
    fewer words has one shingle of its whole sequence, one without words none.
    A hash is made of both lanes of the words, so that texts made to collide in
    one do not collide here; two given windows share one by chance of 2^-64."""
    if not len(words.start):
        return np.zeros(0, np.uint64), words.off
    (a, off), (b, _) = (_windows(words.lane(i), words.off, n, _STEP[i]) for i in (0, 1))
    return a ^ b, off


def distinct_per_row(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and their offsets."""
    parts, sizes = [], [0]
    for i in range(len(off) - 1):
        u = np.unique(h[off[i] : off[i + 1]])
        parts.append(u)
        sizes.append(len(u))
    return (np.concatenate(parts) if parts else h[:0]), np.cumsum(sizes)
