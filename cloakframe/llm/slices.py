"""Documents packed into slices (rows of a few MB), and what slices exchange with hash buckets.

``build_slices`` keeps doc_id order: a slice has all rows of its doc_ids, or rows of one doc_id only
(``rank`` is its least doc_id), so "in a document with a smaller doc_id" is "in a slice of lower rank,
or earlier in this one", and rows that share a doc_id (or have none) never have to fit into one slice.
The tables are bucketed by slice: results that belong to a slice are joined to it without moving the
text again.

A slice sends each hash bucket one packed row.  Buckets follow the size of the input, so no group
grows with it; in the limit a packed row holds a few entries, as a plain shuffle's rows do.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import brief_shuffles, partitions_for, shared_dir
from .words import give_back

SLICE_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
SCHEMA = "slice long, rank long, doc_ids binary, offsets binary, text binary"


def total_bytes(docs: DataFrame) -> int:
    return int(docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0)


#: Stands for a null doc_id inside a slice; sorts first.
NO_ID = -(1 << 63)


class SliceWriter:
    """Cuts rows in doc_id order into slices."""

    def __init__(self, slice_bytes: int):
        self.slice_bytes, self.base, self.seq = slice_bytes, TaskContext.get().partitionId() << 32, 0
        self.ids: list[int] = []
        self.texts: list[bytes] = []
        self.held = self.run = 0  # bytes, and where the rows of the last doc_id begin
        self.apart: list[int] = []  # the partition's first doc_id (others may hold it too) and one whose rows were cut

    def add(self, doc_id: int, text: bytes) -> Iterator[pa.RecordBatch]:
        if not self.ids:
            self.run = 0
            self.apart = self.apart or [doc_id]
        elif doc_id != self.ids[-1]:
            if self.held >= self.slice_bytes or self.ids[-1] in self.apart:
                yield from self.flush(len(self.ids))
            self.run = len(self.ids)
        elif self.held >= self.slice_bytes:  # inside the rows of one doc_id: they get slices of their own
            yield from self.flush(self.run)
            if sum(map(len, self.texts)) >= self.slice_bytes:
                yield from self.flush(len(self.ids))
                self.apart = [self.apart[0], doc_id]
        self.ids.append(doc_id)
        self.texts.append(text)
        self.held += len(text)

    def flush(self, n: int) -> Iterator[pa.RecordBatch]:
        """A slice of the first n rows."""
        if n:
            ids, texts = self.ids[:n], self.texts[:n]
            offsets = np.cumsum([0, *map(len, texts)])
            columns = [np.array(ids, np.int64).tobytes(), offsets.astype(np.int64).tobytes(), b"".join(texts)]
            yield pa.RecordBatch.from_arrays([pa.array([self.base + self.seq]), pa.array([ids[0]]), *(pa.array([c], pa.binary()) for c in columns)], names=["slice", "rank", "doc_ids", "offsets", "text"])
            self.seq += 1
            del self.ids[:n], self.texts[:n]
        self.held, self.run = sum(map(len, self.texts)), 0

    def close(self) -> Iterator[pa.RecordBatch]:
        """The last doc_id goes apart: the next partition may hold it too."""
        if self.ids:
            yield from self.flush(self.run)
            yield from self.flush(len(self.ids))


def build_slices(docs: DataFrame, size: int, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The slices of the rows; null text is empty, a null doc_id is NO_ID."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = SliceWriter(slice_bytes)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                yield from writer.add(doc_id, text.as_py() or b"")
        yield from writer.close()

    tie = F.xxhash64("text")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    ordered = rows.repartitionByRange(partitions_for(docs), "doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    return bucketed(ordered.mapInArrow(cut, SCHEMA), table_buckets(docs.sparkSession, size))


def table_buckets(spark: SparkSession, size: int) -> int:
    """Buckets of the tables of slices; size: bytes of all texts."""
    return min(max(2 * spark.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES)), 100_000)


def bucketed(slices: DataFrame, buckets: int) -> DataFrame:
    """The rows as a table of its own, bucketed by slice."""
    spark = slices.sparkSession
    name = f"cloakframe_slices_{uuid.uuid4().hex}"
    with brief_shuffles(spark):
        slices.write.bucketBy(buckets, "slice").option("compression", "zstd").option("path", shared_dir(spark, "slices")).saveAsTable(name)
    return spark.table(name)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _binary(data: np.ndarray, cuts: np.ndarray, planes: bool) -> pa.Array:
    """One binary value for each run of data between two cuts, without a copy; planes: bytes of one place together."""
    size = data.itemsize
    if planes and len(data):
        lengths = np.diff(cuts)
        place, step = np.arange(len(data)) + np.repeat(cuts[:-1] * (size - 1), lengths), np.repeat(lengths, lengths)
        raw, data = np.ascontiguousarray(data).view(np.uint8).reshape(-1, size), np.empty(len(data) * size, np.uint8)
        for k in range(size):
            data[place + k * step] = raw[:, k]
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * size).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def to_planes(data: np.ndarray) -> bytes:
    """The bytes of one place together: numbers that are small most of the time compress far better so."""
    raw = np.ascontiguousarray(data).view(np.uint8).reshape(-1, data.itemsize)
    return np.stack([raw[:, k] for k in range(data.itemsize)]).tobytes()


def from_planes(raw: bytes | memoryview | pa.Buffer, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(raw, np.uint8).reshape(size, -1)
    # plane by plane: a transposed copy takes several times as long
    out = np.empty((planes.shape[1], size), np.uint8)
    for k in range(size):
        out[:, k] = planes[k]
    return out.view(kind).reshape(-1)


def packed_rows(schema: pa.Schema, number: int, bucket: np.ndarray, columns: list[np.ndarray], bucket2: np.ndarray | None = None, columns2: list[np.ndarray] | tuple = (), planes: tuple[int, ...] = ()) -> pa.RecordBatch:
    """A row for each bucket: entries (columns, with ascending ``bucket``) and groups of them (columns2, with ``bucket2``).

    ``planes``: places of the columns that are stored as ``to_planes`` does.
    """
    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
    names = bucket[cuts[:-1]]
    cuts2 = np.append(np.searchsorted(bucket2, names), len(bucket2)) if columns2 else None
    values = [_binary(c, cuts if k < len(columns) else cuts2, k in planes) for k, c in enumerate([*columns, *columns2])]
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.full(len(names), number, np.int64)), *values], schema=schema)


def ids_array(ids: np.ndarray) -> pa.Array:
    """doc_ids for output, NO_ID as null."""
    return pa.array(ids, mask=ids == NO_ID)


def slice_rows(batches: Iterator[pa.RecordBatch], trim: bool = True) -> Iterator[dict]:
    """The rows of Arrow batches one by one.

    trim: give memory back before each row; otherwise once after the last, for rows that all need about
    the same: to touch it anew for each row costs about as much as a third of the work on it.
    """
    for batch in batches:
        for k in range(batch.num_rows):
            if trim:
                give_back()
            yield batch.slice(k, 1).to_pylist()[0]
    if not trim:
        give_back()


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, offsets and text bytes of a slice row."""
    return np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["offsets"], np.int64), np.frombuffer(row["text"], np.uint8)
