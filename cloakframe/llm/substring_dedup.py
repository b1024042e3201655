"""Substring deduplication by fixed-block anchors.

A word goes if a window of ``WINDOW`` words that covers it also starts in a document with a smaller
doc_id.  Anchors find where that can be: every document's non-overlapping blocks of ``BLOCK`` words
are the index, and every rolling window of ``BLOCK`` words is a probe; since WINDOW >= 2 * BLOCK - 1,
any common window holds a whole index block of either document.  Probes and index blocks meet as
4-byte fingerprints in hash buckets, one packed row for each slice and bucket, and a bit for each
entry comes back.  Hits are then extended: of the slices' places with hits, the exact windows
around them are hashed (64 bits) and the least rank of a slice with each is found the same way.  Overlapping
windows join to the maximal repeats whose words go.

Before anything is sent, a slice (see ``slices``) resolves what repeats inside it and sends one
entry for each distinct value, so a passage that stands in a third of all documents costs an entry
for each slice, not for each document.  The text moves once, when the slices are made.

Defined results: null or empty text has no words; rows with one doc_id are judged against smaller
doc_ids only, each on its own; a row whose doc_id is null keeps all its words and is no source for
others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize
from .slices import SLICE_BYTES, bucket_of, build_slices, packed_rows, slice_rows, total_bytes, unpack
from .words import SPACE, Words, split_words

WINDOW = 13
BLOCK = 7
#: Bytes of text for each hash bucket.
BUCKET_TEXT = 2 << 20
ENTRY = "bucket long, slice long, entries binary"
FLAGS = "slice long, bucket long, bits binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


ENTRY_SCHEMA = pa.schema([("bucket", pa.int64()), ("slice", pa.int64()), ("entries", pa.binary())])
WINDOW_SCHEMA = ENTRY_SCHEMA.append(pa.field("rank", pa.int64()))
FLAG_SCHEMA = pa.schema([("slice", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())])
#: Bits of a fingerprint within its bucket.
PRINT = np.uint64(30)


@dataclass
class Anchors:
    """Distinct anchor hashes of a slice in (bucket, fingerprint) order."""

    words: Words
    at: np.ndarray  # first word of each rolling window
    inverse: np.ndarray  # its entry
    bucket: np.ndarray
    print32: np.ndarray
    aligned: np.ndarray
    shared: np.ndarray  # stands in two documents of the slice

    @classmethod
    def of(cls, offsets: np.ndarray, text: np.ndarray, ids: np.ndarray, buckets: int) -> Anchors:
        w = split_words(text, offsets, SPACE)
        at, h = w.grams(BLOCK)
        # bucket, then a fingerprint: two hashes that agree on both are one entry
        mask = np.uint64((1 << 30) - 1)
        key = (bucket_of(h, buckets).astype(np.uint64) << PRINT) | (h & mask)
        keys, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        inverse = inverse.reshape(-1)
        aligned, shared = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        aligned[inverse[(at - w.first[w.doc[at]]) % BLOCK == 0]] = True
        owner = ids[w.doc[at]]
        shared[inverse[owner != owner[first][inverse]]] = True
        return cls(w, at, inverse, (keys >> PRINT).astype(np.int64), (keys & mask).astype(np.uint32), aligned, shared)

    def windows(self, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of the exact windows that hold an active anchor."""
        hit = np.zeros(len(self.words.doc) + 1, np.int64)
        hit[self.at[active[self.inverse]] + 1] = 1
        total = np.cumsum(hit)
        at, h = self.words.grams(WINDOW)
        near = total[at + WINDOW - BLOCK + 1] > total[at]
        return at[near], h[near]


def _received(bits: list[dict] | None, bucket: np.ndarray) -> np.ndarray:
    """The flags that came back, in entry order."""
    out = np.zeros(len(bucket), bool)
    bits = bits or []
    names = np.array([x["bucket"] for x in bits], np.int64)
    for x, lo, hi in zip(bits, np.searchsorted(bucket, names).tolist(), np.searchsorted(bucket, names, "right").tolist()):
        out[lo:hi] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=hi - lo).astype(bool)
    return out


def _exact(a: Anchors, active: np.ndarray, ids: np.ndarray, buckets: int) -> tuple[np.ndarray, ...]:
    """Windows around active anchors: first words, entry of each, entries' buckets and hashes, least doc_id."""
    at, h = a.windows(active)
    keys, inverse = np.unique(h, return_inverse=True)
    inverse = inverse.reshape(-1)
    owner = ids[a.words.doc[at]]
    least = np.full(len(keys), np.iinfo(np.int64).max)
    np.minimum.at(least, inverse, owner)
    return at, inverse, bucket_of(keys, buckets), keys, least


def dedup(docs: DataFrame, slice_bytes: int = SLICE_BYTES, bucket_text: int = BUCKET_TEXT) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document."""
    size = total_bytes(docs)
    buckets = max(16, -(-size // bucket_text))
    slices = build_slices(docs.where("doc_id is not null"), size, slice_bytes)

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in slice_rows(batches):
            ids, offsets, text = unpack(row)
            a = Anchors.of(offsets, text, ids, buckets)
            entries = (a.print32 << np.uint32(2)) | (a.aligned.astype(np.uint32) << np.uint32(1)) | a.shared
            yield packed_rows(ENTRY_SCHEMA, row["slice"], a.bucket, [entries.astype(np.uint32)])

    def meet_anchors(table: pa.Table) -> pa.Table:
        """Anchors with an index block that stand in two documents."""
        parts = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("entries")]
        every = np.concatenate(parts)
        _, inverse, counts = np.unique(every >> np.uint32(2), return_inverse=True, return_counts=True)
        inverse = inverse.reshape(-1)
        aligned, shared = np.zeros(len(counts), bool), counts > 1
        aligned[inverse[(every & np.uint32(2)) > 0]] = True
        shared[inverse[(every & np.uint32(1)) > 0]] = True
        return _answer(table, parts, (aligned & shared)[inverse])

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in slice_rows(batches):
            ids, offsets, text = unpack(row)
            a = Anchors.of(offsets, text, ids, buckets)
            _, _, bucket, keys, _ = _exact(a, _received(row["anchors"], a.bucket), ids, buckets)
            ranks = np.full(int((np.diff(bucket, prepend=-1) != 0).sum()), row["rank"], np.int64)
            rows = packed_rows(ENTRY_SCHEMA, row["slice"], bucket, [keys])
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(ranks)], schema=WINDOW_SCHEMA)

    def meet_windows(table: pa.Table) -> pa.Table:
        """Windows that a slice of lower rank holds."""
        parts = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("entries")]
        every = np.concatenate(parts)
        number = np.repeat(table.column("rank").to_numpy(), [len(p) for p in parts])
        keys, inverse = np.unique(every, return_inverse=True)
        first = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(first, inverse.reshape(-1), number)
        return _answer(table, parts, first[inverse.reshape(-1)] < number)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in slice_rows(batches):
            ids, offsets, text = unpack(row)
            a = Anchors.of(offsets, text, ids, buckets)
            at, inverse, bucket, _, least = _exact(a, _received(row["anchors"], a.bucket), ids, buckets)
            owner = ids[a.words.doc[at]]
            gone = at[_received(row["windows"], bucket)[inverse] | (least[inverse] < owner)]
            edge = np.zeros(len(a.words.doc) + 1, np.int64)
            np.add.at(edge, gone, 1)
            np.add.at(edge, gone + WINDOW, -1)
            removed = np.cumsum(edge)[:-1] > 0
            yield _digest(ids, offsets, text, a.words, removed)

    anchors = materialize(_back(slices.mapInArrow(send_anchors, ENTRY).groupBy("bucket").applyInArrow(meet_anchors, FLAGS), "anchors"), "anchors")
    hit = slices.join(anchors.hint("shuffle_hash"), "slice", "left")
    windows = _back(hit.mapInArrow(send_windows, f"{ENTRY}, rank long").groupBy("bucket").applyInArrow(meet_windows, FLAGS), "windows")
    done = hit.join(windows.hint("shuffle_hash"), "slice", "left").mapInArrow(finish, RESULT)
    return done.unionByName(without_id(docs))


def _answer(table: pa.Table, parts: list[np.ndarray], flags: np.ndarray) -> pa.Table:
    """Packed flags for each row that has any, in the order of its entries."""
    rows, at = [], 0
    for number, bucket, part in zip(table.column("slice").to_pylist(), table.column("bucket").to_pylist(), parts):
        own = flags[at : at + len(part)]
        at += len(part)
        if own.any():
            rows.append({"slice": number, "bucket": bucket, "bits": np.packbits(own).tobytes()})
    return pa.Table.from_pylist(rows, schema=FLAG_SCHEMA)


def _back(flags: DataFrame, name: str) -> DataFrame:
    return flags.groupBy("slice").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))


def _digest(ids: np.ndarray, offsets: np.ndarray, text: np.ndarray, w: Words, removed: np.ndarray) -> pa.RecordBatch:
    raw, first = text.tobytes(), w.first
    before = np.concatenate([[0], np.cumsum(removed)])
    n_removed = before[first[1:]] - before[first[:-1]]
    sums = []
    for d in range(len(ids)):
        words = raw[offsets[d] : offsets[d + 1]].split()  # bytes.split() knows the same six separators
        if n_removed[d]:
            words = compress(words, ~removed[first[d] : first[d + 1]])
        sums.append(hashlib.sha256(b" ".join(words)).hexdigest())
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(w.counts.astype(np.int64)), pa.array(n_removed.astype(np.int64)), pa.array(sums)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def without_id(docs: DataFrame) -> DataFrame:
    """Rows that have no doc_id keep all their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x or "").encode() for x in batch.column(0).to_pylist()]
            offsets = np.cumsum([0, *map(len, texts)])
            text = np.frombuffer(b"".join(texts), np.uint8)
            w = split_words(text, offsets, SPACE, hashed=False)
            out = _digest(np.zeros(len(texts), np.int64), offsets, text, w, np.zeros(len(w.doc), bool))
            yield out.set_column(0, "doc_id", pa.nulls(len(texts), pa.int64()))

    return docs.where("doc_id is null").select("text").mapInArrow(run, RESULT)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def brute_force(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """Plain reference for tests."""
    import re

    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least: dict[tuple, int] = {}
    for i, w in docs:
        for k in range(len(w) - WINDOW + 1 if i is not None else 0):
            key = tuple(w[k : k + WINDOW])
            least[key] = min(i, least.get(key, i))
    out = []
    for i, w in docs:
        gone = set()
        for k in range(len(w) - WINDOW + 1 if i is not None else 0):
            if least[tuple(w[k : k + WINDOW])] < i:
                gone.update(range(k, k + WINDOW))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
