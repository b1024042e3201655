"""Vectorised word and n-gram hashing over the UTF-8 buffer of an Arrow text column.

Everything works on slices of a batch (``text_slices``): whole documents, a few MB of text at a
time, so that a Python worker's memory does not follow the batch size.  Separators are ASCII, so
working on UTF-8 bytes gives the same words as working on characters.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 2**64)
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
GRAM_MUL = U64(0xD6E8FEB86659FD93)


def _bytes(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


#: Bytes between words of ``[^\x20\x09-\x0D]+``.
SPACE = _bytes((0x20, 0x20), (0x09, 0x0D))
#: Bytes between words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z is lower-cased.
NOT_ALNUM = _bytes((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R^i and R^-i modulo 2^64 for i < n (grown by doubling, kept for the worker's life)."""
    while len(_POW[0]) < n:
        for k, base in ((0, _R), (1, _RINV)):
            have = _POW[k]
            _POW[k] = np.concatenate([have, have * U64(pow(base, len(have), 2**64))])
    return _POW[0][:n], _POW[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (public domain), element by element."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


@dataclass
class Words:
    """The words of some documents; ``doc`` is the document's index in the slice."""

    buf: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    counts: np.ndarray
    hash: np.ndarray | None

    @property
    def first(self) -> np.ndarray:
        """Index of each document's first word, and of the end."""
        return np.concatenate([[0], np.cumsum(self.counts)])

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start index and 64-bit hash of every window of k words inside one document."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        g = self.hash[:n].copy()
        for j in range(1, k):
            g *= GRAM_MUL
            g += self.hash[j : n + j]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, mix(g[at])


def split_words(buf: np.ndarray, offsets: np.ndarray, sep: np.ndarray, lower: bool = False, hashed: bool = True) -> Words:
    """Words of the documents ``buf[offsets[i]:offsets[i+1]]``; runs of bytes not in ``sep``."""
    if lower:
        buf = LOWER[buf]
    n = len(buf)
    inside = ~sep[buf]
    before = np.empty(n, bool)
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[:-1] = inside[1:]
    if n:
        edges = offsets[(offsets >= 0) & (offsets < n)]
        before[edges] = False
        after[edges - 1] = False  # edge 0 wraps to the last byte, which ends the slice anyway
        after[n - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    counts = np.diff(np.searchsorted(start, offsets))
    doc = np.repeat(np.arange(len(counts)), counts)
    return Words(buf, doc, start, end, counts, span_hashes(buf, start, end) if hashed else None)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings ``buf[start[i]:end[i]]``."""
    n = len(buf)
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODE[buf] * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def ragged(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices begins[i] .. begins[i] + lengths[i] - 1 of every i, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(begins - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


_LIBC = ctypes.CDLL(None)


def give_back() -> None:
    """Return freed memory to the system: workers live on for later tasks, beside other workers."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def text_slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = 1 << 20, trim: bool = True) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of whole documents of about ``max_bytes``; null is empty.

    Memory of earlier batches goes back to the system first (see ``give_back``), unless ``trim`` is off.
    """
    if trim:
        give_back()
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64, len(col) + 1, col.offset * 8) if offs is not None and len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        own = offsets[lo : hi + 1]
        yield slice(lo, hi), data[own[0] : own[-1]], own - own[0]
        lo = hi


def text_runs(batches: Iterator[pa.RecordBatch], run_bytes: int, trim: bool = True) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(first column, bytes, offsets) of whole documents in runs of about ``run_bytes`` over several batches.

    Memory goes back to the system after each run, unless ``trim`` is off.
    """
    ids, parts, counts, held = [], [], [], 0

    def run() -> tuple[pa.Array, np.ndarray, np.ndarray]:
        out = pa.concat_arrays(ids), np.concatenate(parts), np.append(0, np.cumsum(np.concatenate(counts)))
        ids.clear(), parts.clear(), counts.clear()
        if trim:
            give_back()
        return out

    for batch in batches:
        for rows, buf, offsets in text_slices(batch, max_bytes=run_bytes, trim=False):
            ids.append(batch.column(0)[rows.start : rows.stop])
            parts.append(buf)
            counts.append(np.diff(offsets))
            held += len(buf)
            if held >= run_bytes:
                yield run()
                held = 0
    if ids:
        yield run()
