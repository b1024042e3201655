"""Search for many literals at once: texts are probed with rolling hashes, and hits are joined with the literals.

Literals fall into classes by length: class p has those of p to 2p - 1 characters.  A text gives a
hash of every window of p characters, all positions in one numpy pass; a bit table of the literals'
first p characters drops nearly all of them.  For those left, windows of the lengths that the class
has are looked up in a second bit table.  What passes both goes to an equality join on the literal
itself, which drops chance hits, so the result is exact.  Literals stay a table: only the two bit
tables (``MOST_BITS`` bits each at most) and the list of lengths go to every task.

Defined results: offsets are code points; null texts and null or empty literals have no hits; literals
that occur twice in the table count once.  Texts of any length are read in overlapping pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.operators.detect import spread
from cloakframe.storage import keep

#: Longest first window, characters of a run of texts, least and most bits (as a power of two) of a bit table.
TOP_CLASS, RUN_CHARS, LEAST_BITS, MOST_BITS = 64, 1 << 19, 16, 27
#: Literals up to this number, of up to so many characters together, are broadcast to the hits; more are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 8_000_000
_R = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R^i and R^-i modulo 2^64, i < n."""
    out = []
    for base in (_R, pow(_R, -1, 1 << 64)):
        p = np.ones(1, np.uint64)
        while len(p) < n:
            p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
        out.append(p[:n])
    return out[0], out[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Hashes of windows of some code points."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        size = 1 << max(10, int(n).bit_length())
        up, self.down = _powers(size)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mixed(codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def windows(self, at: np.ndarray | slice, ends: np.ndarray | slice, length: int, bits: int) -> np.ndarray:
        """The slot of the windows from ``at`` to ``ends``, of one length."""
        h = _mixed((self.sums[ends] - self.sums[at]) * self.down[at] + np.uint64(length))
        return (h >> np.uint64(64 - bits)).astype(np.int64)


def class_of(length: int) -> int:
    return min(TOP_CLASS, 1 << (length.bit_length() - 1))


def _slots(literals: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The slots of the first windows and of the whole literals."""
    sizes = np.array([len(s) for s in literals], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    rolling = Rolling(np.frombuffer("".join(literals).encode("utf-32-le", "surrogatepass"), np.uint32))
    first, whole = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for n in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == n)
        p = class_of(n)
        first[own] = rolling.windows(starts[own], starts[own] + p, p, bits)
        whole[own] = rolling.windows(starts[own], ends[own], n, bits)
    return first, whole


def _table(literals: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bit tables; slots are put together as words of 64 bits by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, slots in enumerate(_slots(batch.column(0).to_pylist(), bits)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slots), kind, np.int32)), pa.array(slots)], names=["kind", "slot"])

    found = literals.select("look").mapInArrow(run, "kind int, slot long")
    words = found.groupBy("kind", F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("word"))
    tables = np.zeros((2, 1 << (bits - 6)), np.int64)
    for r in words.collect():
        tables[r["kind"], r["at"]] = r["word"]
    return tables[0].view(np.uint8), tables[1].view(np.uint8)


def _set(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (table[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def _places(codes: np.ndarray, room: np.ndarray, own: np.ndarray, lengths: list[int], tables: tuple, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the windows that pass both tables; room: characters from a place to its text's end; own: places that count here."""
    rolling, starts, sizes = Rolling(codes), [], []
    for p in sorted({class_of(n) for n in lengths}):
        if len(codes) < p:
            continue
        last = len(codes) - p + 1
        at = np.flatnonzero(_set(tables[0], rolling.windows(slice(0, last), slice(p, p + last), p, bits)) & (room[:last] >= p) & own[:last])
        for n in (x for x in lengths if class_of(x) == p):
            fit = at[room[at] >= n]
            fit = fit[_set(tables[1], rolling.windows(fit, fit + n, n, bits))]
            starts.append(fit)
            sizes.append(np.full(len(fit), n))
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(starts), np.concatenate(sizes)


def _runs(texts: list[str], longest: int) -> Iterator[tuple[list[tuple[int, int, str]], int]]:
    """Pieces (text, offset, characters) in runs; a piece of a long text holds ``longest - 1`` characters of the next one."""
    held, size = [], 0
    for k, t in enumerate(texts):
        for at in range(0, len(t), RUN_CHARS):
            piece = t[at : at + RUN_CHARS + longest - 1]
            held.append((k, at, piece))
            size += len(piece)
            if size >= RUN_CHARS:
                yield held, size
                held, size = [], 0
    if held:
        yield held, size


def _hits(texts: list[str], lengths: list[int], tables: tuple, bits: int) -> Iterator[tuple[int, int, str]]:
    """(text, start, literal) of everything that passes the tables, text by text in order."""
    for pieces, size in _runs(texts, lengths[-1]):
        joined = "".join(x[2] for x in pieces)
        sizes = np.array([len(x[2]) for x in pieces])
        ends = np.cumsum(sizes)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        which = np.repeat(np.arange(len(pieces)), sizes)
        place = np.arange(size)
        start, length = _places(codes, ends[which] - place, place - (ends - sizes)[which] < RUN_CHARS, lengths, tables, bits)
        order = np.lexsort((length, start))
        start, length = start[order], length[order]
        for s, n, k in zip(start.tolist(), length.tolist(), which[start].tolist()):
            text, at, _ = pieces[k]
            yield text, at + s - int(ends[k] - sizes[k]), joined[s : s + n]


def find_literals(texts: DataFrame, keys: list[str], text: str, literals: DataFrame, show: str | None = None) -> DataFrame:
    """keys, start, end and look of every place of every literal (a table with the column ``look``), overlapping ones too.

    ``show`` is a column with the same offsets, of which ``shown`` has what stands there.
    """
    spark = texts.sparkSession
    looks = keep(literals.where("look is not null and look <> ''").select("look"), "literals")
    seen = looks.groupBy(F.char_length("look").alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()
    given = texts.where(F.col(text).isNotNull()).select(*keys, F.col(show or text).alias("__show"), F.col(text).alias("__text"))
    schema = given.drop("__text", "__show").schema.add("start", "integer").add("end", "integer").add("look", "string").add("shown", "string")
    if not seen:
        return spark.createDataFrame([], schema)
    lengths, count = sorted(r["n"] for r in seen), sum(r["c"] for r in seen)
    bits = min(MOST_BITS, max(LEAST_BITS, (32 * count).bit_length()))
    shared = spark.sparkContext.broadcast(_table(looks, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, starts, found = [], [], []
            looked = batch.column(batch.num_columns - 1).to_pylist()
            others = batch.column(batch.num_columns - 2).to_pylist() if show else None

            def emit() -> pa.RecordBatch:
                own = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:-2]]
                ends = [s + len(x) for s, x in zip(starts, found)]
                shown = [others[k][s:e] for k, s, e in zip(rows, starts, ends)] if show else found
                return pa.RecordBatch.from_arrays([*own, pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(found, pa.string()), pa.array(shown, pa.string())], names=schema.names)

            for k, s, look in _hits(looked, lengths, shared.value, bits):
                rows.append(k), starts.append(s), found.append(look)
                if len(rows) >= 50_000:
                    yield emit()
                    rows.clear(), starts.clear(), found.clear()
            if rows:
                yield emit()

    hits = spread(given).mapInArrow(run, schema)
    small = count <= BROADCAST_ROWS and sum(r["n"] * r["c"] for r in seen) <= BROADCAST_CHARS
    return hits.join(F.broadcast(looks) if small else looks, "look", "left_semi").select(*schema.names)
