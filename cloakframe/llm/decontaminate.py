"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The patterns are the windows of ``window`` consecutive words of each benchmark item (an item with
fewer words is one pattern).  Patterns of one length form a class; a class has a shift table over
blocks of two words (how far the search may move when it sees a block), and buckets by the hash of
the last block that pick the patterns to compare.  Documents are cut into chunks that overlap by a
pattern less one word, and all chunks of a slice move through the shift table side by side, so the
skipping is vectorised without a Python step per word.  Every hit is confirmed by comparing words.

The benchmark is the stated pattern set.  It is searched in blocks of about ``block_words``
words, so what a task holds does not grow with the benchmark; each block adds to the spans of those before.

Defined results: null or empty text has no words and no hits; a null doc_id stays null; repeated
rows give repeated results; null items and items without words never match; equal windows of
several items count for each of them; other columns of the inputs are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches
from .words import GRAM_MUL, NOT_ALNUM, Words, mix, ragged, split_words, text_slices

WINDOW = 10
CHUNK = 512
#: Words of the benchmark that are searched for in one pass.
BLOCK_WORDS = 1 << 20
SPANS = "doc_id long, text string, rest {rest}, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def _block(h: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hash of the block of ``width`` words that ends at ``at``."""
    return mix(h[at] if width == 1 else h[at - 1] * np.uint64(0xA0761D6478BD642F) + h[at])


@dataclass
class PatternClass:
    """Shift table and suffix buckets of the patterns of ``m`` words.

    Distinct patterns are sorted by the hashes of their last block and of all their words; ``text``
    holds the items' words joined by blanks, and ``begin`` and ``end`` a pattern's bytes in it.
    """

    m: int
    width: int
    bits: int
    shift: np.ndarray
    tails: np.ndarray
    grams: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    text: bytes
    #: Items of pattern k: items[item_at[k] : item_at[k + 1]].
    items: np.ndarray
    item_at: np.ndarray

    @classmethod
    def of(cls, m: int, w: Words, names: np.ndarray) -> PatternClass:
        """Of the windows of m words of each item; w: the items' words, names: of each item."""
        width = min(2, m)
        at, grams = w.grams(m)
        order = np.lexsort((names[w.doc[at]], grams))
        at, grams, item = at[order], grams[order], names[w.doc[at]][order]
        new = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]) | (item[1:] != item[:-1])])) if len(at) else np.empty(0, np.int64)
        at, grams, item = at[new], grams[new], item[new]
        head = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(at) else np.empty(0, np.int64)
        first = at[head]
        bits = int(np.clip(np.ceil(np.log2(max(len(first) * m, 1))) + 3, 12, 24))
        shift = np.full(1 << bits, m - width + 1, np.uint8 if m < 200 else np.int32)
        for end in range(width - 1, m):
            np.minimum.at(shift, (_block(w.hash, first + end, width) >> np.uint64(64 - bits)).astype(np.int64), shift.dtype.type(m - 1 - end))
        tails = _block(w.hash, first + m - 1, width)
        return cls(m, width, bits, shift, np.unique(tails), grams[head], w.start[first], w.end[first + m - 1], w.buf.tobytes(), item, np.append(head, len(at)))

    def search(self, w: Words) -> list[tuple[int, int]]:
        """(index of the first word, pattern) for every occurrence."""
        m, first = self.m, w.first
        pieces = np.maximum(0, -(-(w.counts - m + 1) // CHUNK))  # of windows, CHUNK of them each
        doc = np.repeat(np.arange(len(pieces)), pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = first[doc] + piece * CHUNK + m - 1
        stop = np.minimum(at + CHUNK, first[doc + 1])
        zero = []
        while len(at):
            step = self.shift[(_block(w.hash, at, self.width) >> np.uint64(64 - self.bits)).astype(np.int64)]
            zero.append(at[step == 0])
            at = at + np.maximum(step, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        ends = np.concatenate(zero) if zero else np.empty(0, np.int64)
        tail = _block(w.hash, ends, self.width)
        ends = ends[self.tails[np.minimum(np.searchsorted(self.tails, tail), len(self.tails) - 1)] == tail]
        if not len(ends):
            return []
        gram = w.hash[ends - m + 1].copy()
        for j in range(1, m):
            gram = gram * GRAM_MUL + w.hash[ends - m + 1 + j]
        gram = mix(gram)
        k = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        same = self.grams[k] == gram
        found = []
        for at, k in zip((ends[same] - m + 1).tolist(), k[same].tolist()):
            if b" ".join(w.word(at + j) for j in range(m)) == self.text[self.begin[k] : self.end[k]]:
                found.append((at, k))
        return found

    def items_of(self, k: int) -> list[str]:
        return self.items[self.item_at[k] : self.item_at[k + 1]].tolist()


def build_classes(items: list[tuple[str, str | None]], window: int = WINDOW) -> list[PatternClass]:
    texts = [(text or "").encode() for _, text in items]
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    offsets = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
    offsets[-1] = len(raw)
    w = split_words(raw, offsets, NOT_ALNUM, lower=True, hashed=False)
    # the words alone, joined by blanks
    size = w.end - w.start
    at = np.append(0, np.cumsum(size + 1))
    text = np.full(at[-1], 0x20, np.uint8)
    text[ragged(at[:-1], size)] = w.buf[ragged(w.start, size)]
    names, counts, first = np.array([name for name, _ in items], object), w.counts, w.first
    out = []
    for m in sorted(set(np.minimum(counts, window).tolist()) - {0}):
        own = np.flatnonzero(np.minimum(counts, window) == m)
        bounds = np.append(at[first[own]], 0)
        spans = ragged(bounds[:-1], at[first[own + 1]] - bounds[:-1])
        cut = np.append(0, np.cumsum(at[first[own + 1]] - bounds[:-1]))
        out.append(PatternClass.of(m, split_words(text[spans], cut, NOT_ALNUM), names[own]))
    return out


def _cover(starts: list[int], ends: list[int]) -> list[dict]:
    """Sorted union of half-open spans."""
    out: list[dict] = []
    for s, e in sorted(zip(starts, ends)):
        if out and s <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], e)
        else:
            out.append({"start": s, "end": e})
    return out


def find_spans(docs: DataFrame, items: list[tuple[str, str | None]], window: int = WINDOW) -> DataFrame:
    """Adds the hits of one block of items to doc_id, text, rest, spans and items."""
    shared = docs.sparkSession.sparkContext.broadcast(build_classes(items, window))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = shared.value
        for batch in batches:
            for rows, buf, offsets in text_slices(batch):
                w = split_words(buf, offsets, NOT_ALNUM, lower=True)
                first, hits = w.first, defaultdict(lambda: ([], [], set()))
                own = batch.slice(rows.start, rows.stop - rows.start)
                for d, (spans, names) in enumerate(zip(own.column("spans").to_pylist(), own.column("items").to_pylist())):
                    if spans:
                        hits[d] = ([x["start"] for x in spans], [x["end"] for x in spans], set(names))
                for c in classes:
                    for at, k in c.search(w):
                        d = int(w.doc[at])
                        starts, ends, found = hits[d]
                        starts.append(at - int(first[d]))
                        ends.append(at - int(first[d]) + c.m)
                        found.update(c.items_of(k))
                none = ([], [], ())
                got = [hits[d] if d in hits else none for d in range(len(w.counts))]
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column("doc_id").cast(pa.int64()),
                        own.column("text"),
                        own.column("rest"),
                        pa.array(w.counts.astype(np.int64)),
                        pa.array([_cover(s, e) for s, e, _ in got], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array([sorted(found) for _, _, found in got], pa.list_(pa.string())),
                    ],
                    names=["doc_id", "text", "rest", "n_words", "spans", "items"],
                )

    given = docs.select("doc_id", "text", "rest", "spans", "items")
    return given.mapInArrow(search, SPANS.format(rest=given.schema["rest"].dataType.simpleString()))


def item_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of bounded size, read partition by partition."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string"))
    for item, text in rows.where("item_id is not null and text is not null").toLocalIterator():
        block.append((item, text))
        size += len(text) // 4 + 1  # a bound on its words but for very short ones
        if size >= block_words:
            yield block
            block, size = [], 0
    yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, text, rest (the other columns), n_words, spans (hit words as half-open ranges), items (matching item_ids).

    One pass over the documents for each block of items; a pass adds to the spans of those before.
    """
    bounded_batches(docs.sparkSession)
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0).alias("none")]
    found = docs.select("doc_id", "text", F.struct(*rest).alias("rest"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    for block in item_blocks(benchmark, block_words):
        found = find_spans(found, block, window)
    return found


def digest(found: DataFrame) -> DataFrame:
    """The per-document figures of ``op9_decontaminate``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[str, str | None]], window: int = WINDOW) -> list[tuple]:
    """Plain reference for tests."""
    import re

    def words(text: str | None) -> list[str]:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    patterns: dict[tuple, set[str]] = {}
    for item, pattern in items:
        p = words(pattern)
        m = min(window, len(p))
        for i in range(len(p) - m + 1 if m else 0):
            patterns.setdefault(tuple(p[i : i + m]), set()).add(item)
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for m in {len(p) for p in patterns}:
            for j in range(len(own) - m + 1):
                if tuple(own[j : j + m]) in patterns:
                    hit.update(range(j, j + m))
                    found |= patterns[tuple(own[j : j + m])]
        out.append((doc_id, len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out
