"""License scans: winnowed fingerprints pick candidates, banded alignment confirms them.

Templates and documents are lower-cased words.  The 3-word shingles of a text are winnowed: each
window of 2 consecutive shingles keeps its smallest hash, so any 4 words in common share a
fingerprint.  Templates shorter than that share one with every text that holds them only if all
shingles of the text are looked up, so theirs are.  The templates' fingerprints form an inverted index (small: it follows the number of
templates); a document's fingerprints are looked up in it, and hits on neighbouring diagonals
make a candidate place.  There the template is aligned with the document's words inside a band
around the diagonal.  An alignment that covers at least ``min_coverage`` of the template's words
is reported with its coverage and span; of overlapping reports the one with more matched words
stays.  The band is narrower for short templates.  Templates of fewer than 3 words are left out.

Defined results: null or empty text has no words and no matches; repeated matches in one text are
all reported; rows and null or repeated doc_ids are kept; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_templates import TEMPLATES
from .words import NOT_ALNUM, Words, split_words, text_slices

SHINGLE = 3
WINNOW = 2
MIN_COVERAGE = 0.8
BAND = 8


def winnow(w: Words, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of the fingerprints: least shingles of each window of one document, and those in ``short``."""
    at, h = w.grams(SHINGLE)
    if not len(at):
        return at, h
    keep = np.zeros(len(at), bool)
    same = w.doc[at[1:]] == w.doc[at[:-1]]
    left = h[:-1] <= h[1:]
    keep[:-1] |= same & left
    keep[1:] |= same & (h[1:] <= h[:-1])
    alone = np.concatenate([[True], ~same]) & np.concatenate([~same, [True]])
    keep |= alone | np.isin(h, short)
    return at[keep], h[keep]


def words_of(text: str) -> Words:
    raw = np.frombuffer(text.encode(), np.uint8)
    return split_words(raw, np.array([0, len(raw)]), NOT_ALNUM, lower=True)


class Index:
    """Inverted index of the templates' fingerprints; ``short``: those of templates that no window of a text may cover."""

    def __init__(self, templates: dict[str, str]):
        self.names, self.words = [], []
        postings = defaultdict(list)
        short = set()
        for name, text in sorted(templates.items()):
            w = words_of(text)
            if len(w.hash) < SHINGLE:
                continue  # too short to tell from prose
            for at, h in zip(*(x.tolist() for x in w.grams(SHINGLE))):
                postings[h].append((len(self.names), at))
                if len(w.hash) < SHINGLE + WINNOW - 1:
                    short.add(h)
            self.names.append(name)
            self.words.append(w.hash)
        self.keys = np.array(sorted(postings), np.uint64)
        self.postings = [postings[k] for k in self.keys.tolist()]
        self.short = np.array(sorted(short), np.uint64)


def align(template: np.ndarray, text: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """(matched words, start, end) of the best alignment of the template with text inside the band.

    Row i allows text positions i + shift - band .. i + shift + band.  A match scores 2, a change or
    a gap -1; template words before and after the alignment are free, and so is the text.
    """
    width = 2 * band + 1
    score, matched, start = np.zeros(width, np.int64), np.zeros(width, np.int64), np.zeros(width, np.int64)
    best = (0, 0, 0, 0)
    for i, word in enumerate(template):
        lo = i + shift - band
        new, new_m, new_s = np.zeros(width, np.int64), np.zeros(width, np.int64), np.zeros(width, np.int64)
        for c in range(width):
            j = lo + c
            if not 0 <= j < len(text):
                continue
            equal = text[j] == word
            options = [(score[c] + (2 if equal else -1), matched[c] + equal, start[c] if score[c] > 0 else j)]
            if c + 1 < width and score[c + 1] > 1:
                options.append((score[c + 1] - 1, matched[c + 1], start[c + 1]))
            if c and new[c - 1] > 1:
                options.append((new[c - 1] - 1, new_m[c - 1], new_s[c - 1]))
            s, m, b = max(options, key=lambda o: (o[0], o[1]))
            if s > 0:
                new[c], new_m[c], new_s[c] = s, m, b
                if (s, m) > best[:2]:
                    best = (int(s), int(m), int(b), j + 1)
        score, matched, start = new, new_m, new_s
    return best[1], best[2], best[3]


def scan_words(w: Words, index: Index, min_coverage: float, band: int) -> dict[int, list[tuple[str, float, int, int, int]]]:
    """Reports (template, coverage, start, end, matched) by document."""
    at, h = winnow(w, index.short)
    if not len(at) or not len(index.keys):
        return {}
    where = np.minimum(np.searchsorted(index.keys, h), len(index.keys) - 1)
    hit = np.flatnonzero(index.keys[where] == h)
    places = defaultdict(set)
    first = w.first
    for pos, k in zip(at[hit].tolist(), where[hit].tolist()):
        d = int(w.doc[pos])
        for t, p in index.postings[k]:
            places[d, t].add(pos - int(first[d]) - p)
    found = defaultdict(list)
    for (d, t), diagonals in places.items():
        text, template = w.hash[first[d] : first[d + 1]], index.words[t]
        own, groups = min(band, max(1, len(template) // 4)), []
        for x in sorted(diagonals):
            if groups and x - groups[-1][0] <= own:
                groups[-1].append(x)
            else:
                groups.append([x])
        for g in groups:
            m, start, end = align(template, text, g[len(g) // 2], own)
            if m >= min_coverage * len(template):
                found[d].append((index.names[t], m / len(template), start, end, m))
    return {d: _best(reports) for d, reports in found.items()}


def _best(reports: list[tuple[str, float, int, int, int]]) -> list[tuple[str, float, int, int, int]]:
    kept: list[tuple[str, float, int, int, int]] = []
    for r in sorted(set(reports), key=lambda r: (-r[4], -r[1], r[2], r[0])):
        if all(r[3] <= k[2] or r[2] >= k[3] for k in kept):
            kept.append(r)
    return sorted(kept, key=lambda r: r[2])


SCANNED = "doc_id long, n_words long, matches array<struct<template:string,coverage:double,start:long,end:long,matched:long>>"


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE, band: int = BAND) -> DataFrame:
    """doc_id, n_words and the matches (spans in words, half-open) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates))
    kind = pa.list_(pa.struct([("template", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for rows, buf, offsets in text_slices(batch):
                w = split_words(buf, offsets, NOT_ALNUM, lower=True)
                found = scan_words(w, index, min_coverage, band)
                names = ("template", "coverage", "start", "end", "matched")
                matches = [[dict(zip(names, r)) for r in found.get(d, ())] for d in range(len(w.counts))]
                yield pa.RecordBatch.from_arrays([ids[rows.start : rows.stop], pa.array(w.counts.astype(np.int64)), pa.array(matches, kind)], names=["doc_id", "n_words", "matches"])

    return docs.select("doc_id", "text").mapInArrow(run, SCANNED)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spans = F.transform("matches", lambda m: F.concat_ws(":", m["template"], F.round(m["coverage"], 4).cast("string"), m["start"].cast("string"), m["end"].cast("string")))
    return found.select("doc_id", "n_words", F.size("matches").cast("long").alias("n_matches"), F.aggregate("matches", F.lit(0).cast("long"), lambda a, m: a + m["matched"]).alias("n_matched_words"), F.array_join(spans, ",").alias("spans"))
