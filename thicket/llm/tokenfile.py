"""Token ids as binary files, compressed document by document.

A dataset is a folder in the shared store with ``segments`` and ``dictionary``,
both written by Spark's own committer, so any store that Spark reads will do
and a lost executor loses nothing. A segment is one image:

    8 bytes   magic "THKTIDS1"
    u32, u32  width of an id in bytes (2 or 4), number of documents
    32 bytes  SHA-256 of the dictionary (zeros: none)
    index     per document: i64 id, u64 offset of its frame, u64 ids before it
              in the segment; then one closing entry
    frames    one zstandard frame a document, all with the shared dictionary

so one document is read by two look-ups in the index and one small frame.
Documents ascend by id through segments and parts. The dictionary is trained on
serialized ids of a bounded sample (``sample_docs`` documents of the smallest
hash, ``sample_chars`` characters of each); that changes sizes, never contents.

Null texts are empty: the end id alone. Null document ids come first and are
read back as null. Repeated rows are kept. An empty table gives no segments.
"""

from __future__ import annotations

import hashlib
import struct
import warnings
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm._vocab import library_encoder
from thicket.llm._words import chunks, tidy
from thicket.llm.bpe import binary_rows
from thicket.llm.packing import append_end

MAGIC = b"THKTIDS1"
HEAD = struct.Struct("<8sII32s")
ENTRY = np.dtype([("id", "<i8"), ("at", "<u8"), ("before", "<u8")])
NO_ID = -(2**63)
SEGMENT_IDS = 1 << 18
SAMPLE_SLICES, SLICE_CHARS = 16, 1024
_COLUMNS = "part int, seg int, first_id long, last_id long, n_docs long, n_ids long, ids_before long, image binary"


def pack_segment(ids: np.ndarray, docs: list[int], rows: np.ndarray, dictionary: bytes, level: int) -> bytes:
    press = _compressor(dictionary, level)
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    raw = memoryview(ids.astype(f"<u{width}").tobytes())
    frames = [press.compress(raw[width * a : width * b]) for a, b in zip(rows[:-1].tolist(), rows[1:].tolist())]
    index = np.zeros(len(docs) + 1, ENTRY)
    index["id"][:-1] = docs
    index["at"][1:] = np.cumsum([len(f) for f in frames])
    index["before"] = rows
    digest = hashlib.sha256(dictionary).digest() if dictionary else bytes(32)
    return b"".join([HEAD.pack(MAGIC, width, len(docs), digest), index.tobytes(), *frames])


class Segment:
    """Reads an image; ``document(i)`` touches one frame."""

    def __init__(self, image: bytes, dictionary: bytes):
        magic, self.width, n, digest = HEAD.unpack_from(image)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        if digest != (hashlib.sha256(dictionary).digest() if dictionary else bytes(32)):
            raise ValueError("segment was written with another dictionary")
        self.index = np.frombuffer(image, ENTRY, n + 1, HEAD.size)
        self.frames = memoryview(image)[HEAD.size + self.index.nbytes :]
        self.press = _decompressor(dictionary)

    def __len__(self) -> int:
        return len(self.index) - 1

    def document(self, i: int) -> np.ndarray:
        a, b = int(self.index["at"][i]), int(self.index["at"][i + 1])
        n = int(self.index["before"][i + 1] - self.index["before"][i])
        return np.frombuffer(self.press.decompress(self.frames[a:b], max_output_size=max(1, n * self.width)), f"<u{self.width}")

    def find(self, doc_id: int) -> np.ndarray | None:
        i = int(np.searchsorted(self.index["id"][:-1], doc_id))
        return self.document(i) if i < len(self) and self.index["id"][i] == doc_id else None


@lru_cache(4)
def _compressor(dictionary: bytes, level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)


@lru_cache(4)
def _decompressor(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def train(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str, text: str, sample_docs: int, dict_bytes: int) -> bytes:
    """A dictionary, or none where the sample is too small for one (with a
    warning). The documents of the smallest hashes are the sample: whole, or, if
    they are longer than all slices together, slices spread over the whole."""
    keys = docs.select(F.xxhash64(F.col(f"`{id_col}`")).alias("k"))
    least = [r.k for r in keys.orderBy("k").limit(sample_docs).collect()]  # the keys alone decide, so tasks send no text
    whole = docs.select(F.xxhash64(F.col(f"`{id_col}`")).alias("k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    at = lambda i: (1 + F.floor(i * (F.length("t") - SLICE_CHARS) / (SAMPLE_SLICES - 1))).cast("int")
    slices = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_SLICES - 1)), lambda i: F.substring(F.col("t"), at(i), F.lit(SLICE_CHARS)))
    cut = F.when(F.length("t") <= SAMPLE_SLICES * SLICE_CHARS, F.array("t")).otherwise(slices)
    own = whole.where(F.col("k") <= least[-1]).select("k", cut.alias("c")).orderBy("k", "c").limit(sample_docs) if least else None
    sample = [t for r in own.collect() for t in r.c] if own is not None else []  # 4 MB of characters at most
    raw = []
    for chunk in chunks(pa.array(sample, pa.large_string())):
        ids, rows, _ = library_encoder(tokenizer_path).encode(chunk)
        ids, rows = append_end(ids, rows, end_id)
        kind = "<u2" if ids.max() < 1 << 16 else "<u4"
        raw += [ids[a:b].astype(kind).tobytes() for a, b in zip(rows, rows[1:])]
    if len(raw) >= 16:
        try:
            return zstandard.train_dictionary(dict_bytes, raw).as_bytes()
        except zstandard.ZstdError as e:
            warnings.warn(f"no dictionary could be trained, documents are compressed without one: {e}", stacklevel=2)
    return b""


def write(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text: str = "text",
    level: int = 3, sample_docs: int = 256, dict_bytes: int = 1 << 15, segment_ids: int = SEGMENT_IDS,
) -> None:
    """Encode, append ``end_id``, write in ascending order of ``id_col``."""
    spark = docs.sparkSession
    dictionary = train(docs, tokenizer_path, end_id, id_col, text, sample_docs, dict_bytes)
    shared = spark.sparkContext.broadcast(dictionary)  # dict_bytes at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = library_encoder(tokenizer_path), TaskContext.get().partitionId()
        seg = before = held = 0
        names: list[int] = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal seg, before, held
            ids, rows = np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            image = pack_segment(ids, names, rows, shared.value, level)
            row = [[part], [seg], [names[0]], [names[-1]], [len(names)], [len(ids)], [before], [image]]
            seg, before, held = seg + 1, before + len(ids), 0
            names.clear(), parts.clear(), sizes.clear()
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], [c.split(" ")[0] for c in _COLUMNS.split(", ")])

        for batch in batches:
            doc = batch.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column(1)):
                ids, rows, _ = encoder.encode(chunk)
                ids, rows = append_end(ids, rows, end_id)
                names += doc[chunk.first : chunk.first + len(chunk)].tolist()
                parts.append(ids)
                sizes.append(np.diff(rows))
                held += len(ids)
                if held >= segment_ids:
                    yield flush()
        if names:
            yield flush()

    ordered = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(tidy(run), _COLUMNS).write.parquet(f"{path}/segments")
    spark.createDataFrame([(bytearray(dictionary),)], "dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")


def _open(spark: SparkSession, path: str) -> tuple[DataFrame, bytes]:
    return spark.read.schema(_COLUMNS).parquet(f"{path}/segments"), bytes(spark.read.schema("dictionary binary").parquet(f"{path}/dictionary").first()[0])


def read_ids(spark: SparkSession, path: str, wanted: Sequence[int], id_col: str = "doc_id") -> DataFrame:
    """``id_col, ids`` of the documents named, a short list (of repeated ids,
    each). Id ranges leave other segments unread, down to Parquet's pages, and
    of a segment only the frames asked for are decompressed."""
    segments, dictionary = _open(spark, path)
    some = sorted(set(map(int, wanted)))
    ranges = [(F.col("first_id") <= i) & (F.col("last_id") >= i) for i in some]
    shared = spark.sparkContext.broadcast((dictionary, np.array(some, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, some = shared.value
        for batch in batches:
            for image in batch.column(0):
                seg = Segment(image.as_py(), dictionary)
                at = np.flatnonzero(np.isin(seg.index["id"][:-1], some))
                ids = [seg.document(k).astype("<u4").tobytes() for k in at.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(seg.index["id"][at]), pa.array(ids, pa.binary())], [id_col, "ids"])

    return segments.where(reduce(lambda a, b: a | b, ranges, F.lit(False))).select("image").mapInArrow(tidy(run), f"`{id_col}` long, ids binary")


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """``id_col, start`` (ids of all documents before it), ``ids`` (binary,
    unsigned 32 bit) of every document in the files."""
    segments, dictionary = _open(spark, path)
    base, total = {}, 0
    for r in sorted(segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):  # a row a written part
        base[r.part] = total
        total += r.n
    shared = spark.sparkContext.broadcast((dictionary, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary, base = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                seg = Segment(batch.column(2)[i].as_py(), dictionary)
                first = base[batch.column(0)[i].as_py()] + batch.column(1)[i].as_py()
                ids = [seg.document(k) for k in range(len(seg))]
                name, before = seg.index["id"][:-1], seg.index["before"].astype(np.int64)
                flat = np.concatenate(ids).astype("<u4")
                yield pa.RecordBatch.from_arrays([pa.array(name, mask=name == NO_ID), pa.array(first + before[:-1]), binary_rows(flat, before)], [id_col, "start", "ids"])

    return segments.select("part", "ids_before", "image").mapInArrow(tidy(run), f"`{id_col}` long, start long, ids binary")
