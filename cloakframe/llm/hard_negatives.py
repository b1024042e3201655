"""Hard negatives by a vector-approximation file: score bounds from quantised cells, exact scores for candidates only.

Vectors lie in chunks of a few thousand rows.  Each dimension of a chunk is quantised into cells;
the chunk stores a cell number for each component and, for each dimension, a table of the least and
the greatest value in every cell.  Looking a row's cells up gives a lower and an upper bound of its
score with an anchor; only rows whose bounds may enter an anchor's window are scored exactly.

Anchors lie in blocks.  A task takes one block and a group of chunks, one chunk after the other, and
keeps a few best rows for each anchor, so neither pairs nor all chunks are ever held; the lists of an
anchor's groups are merged by Spark.  Positives are found in a first pass, negatives in a second one,
inside the windows that the positives' scores give.

Defined results: rows with a null label, a null vector, a null or non-finite component or a null id
take no part; vectors of fewer dimensions count as filled up with 0; rows that repeat an id are rows
of their own (another row with an anchor's id and label is one of its positives); equal scores go by
the smaller id; an anchor without another row of its label, or whose windows are empty, gives no
rows; an empty table gives none.  Components must be so small that scores are exact in doubles (their
squares times dimensions below 2^53), else the query fails.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, materialize

#: Rows of a chunk, anchors of a block, cells of a dimension.
CHUNK_ROWS, BLOCK_ANCHORS, CELLS = 8192, 4096, 16
SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: The window of negatives: LOW * positive <= 100 * negative <= HIGH * positive.
LOW, HIGH = 50, 95
CHUNK = "chunk long, ids binary, labels binary, cells binary, low binary, high binary, vectors binary"
NONE = np.iinfo(np.int64).min


def prepared(vectors: DataFrame, id_col: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """id, label and vector (double) of the rows that take part."""
    x = F.col(f"`{vector}`").cast("array<double>")
    whole = F.forall(x, lambda v: F.coalesce((v == v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)) & ~F.isnan(v))
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), x.alias("x")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(whole)


@dataclass
class Chunk:
    number: int
    ids: np.ndarray
    labels: np.ndarray
    cells: np.ndarray
    low: np.ndarray
    high: np.ndarray
    vectors: np.ndarray

    @classmethod
    def build(cls, number: int, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, cells: int = CELLS) -> Chunk:
        """Cells of equal counts in each dimension; low and high hold the least and greatest value of every cell."""
        n, dims = vectors.shape
        order = np.argsort(ids, kind="stable")
        ids, labels, vectors = ids[order], labels[order], np.ascontiguousarray(vectors[order])
        codes, low, high = np.zeros((n, dims), np.uint8), np.zeros((dims, cells)), np.zeros((dims, cells))
        for d in range(dims):
            edges = np.quantile(vectors[:, d], np.arange(1, cells) / cells, method="lower")
            codes[:, d] = np.searchsorted(edges, vectors[:, d], "right")
            low[d], high[d] = np.inf, -np.inf
            np.minimum.at(low[d], codes[:, d], vectors[:, d])
            np.maximum.at(high[d], codes[:, d], vectors[:, d])
        low[~np.isfinite(low)] = high[~np.isfinite(high)] = 0
        return cls(number, ids, labels, codes, low, high, vectors)

    def row(self) -> list[bytes]:
        return [x.tobytes() for x in (self.ids, self.labels, self.cells, self.low, self.high, self.vectors.astype(np.int32))]

    @classmethod
    def read(cls, number: int, ids: bytes, labels: bytes, cells: bytes, low: bytes, high: bytes, vectors: bytes) -> Chunk:
        n = len(ids) // 8
        shape = (n, -1) if cells else (n, 0)
        table = (-1, CELLS) if low else (0, CELLS)
        return cls(number, np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), np.frombuffer(cells, np.uint8).reshape(shape), np.frombuffer(low).reshape(table), np.frombuffer(high).reshape(table), np.frombuffer(vectors, np.int32).reshape(shape))

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of every anchor's scores (anchors x rows), by each row's cells looked up in the tables."""
        at = np.arange(self.cells.shape[1])
        # sums of products below 2^24 are exact in single precision
        size = max((float(np.abs(t).max()) for t in (self.low, self.high) if t.size), default=0.0) * float(np.abs(anchors).max(initial=0)) * max(1, len(at))
        kind = np.float32 if size < 2**23 else np.float64
        low, high = (t[at, self.cells].astype(kind).T for t in (self.low, self.high))
        plus, minus = np.maximum(anchors, 0).astype(kind), np.minimum(anchors, 0).astype(kind)
        return plus @ low + minus @ high, plus @ high + minus @ low

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact integer scores of some rows."""
        return (self.vectors[rows].astype(np.float64) @ anchor).astype(np.int64)


def chunks(rows: DataFrame, dims: int, size: int) -> DataFrame:
    """The rows as chunks of about ``CHUNK_ROWS``; number and places in a chunk identify a row."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, seq, held, have = TaskContext.get().partitionId() << 32, 0, [], 0

        def emit() -> pa.RecordBatch:
            ids, labels, vectors = (np.concatenate([h[k] for h in held]) for k in range(3))
            out = Chunk.build(base + seq, ids, labels, vectors)
            return pa.RecordBatch.from_arrays([pa.array([out.number], pa.int64()), *(pa.array([b], pa.binary()) for b in out.row())], names=[x.split()[0] for x in CHUNK.split(", ")])

        for batch in batches:
            ends = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            flat, n = batch.column(2).flatten().to_numpy(zero_copy_only=False), batch.num_rows
            vectors = np.zeros((n, dims))
            row = np.repeat(np.arange(n), np.diff(ends))
            vectors[row, np.arange(len(flat)) - ends[row]] = np.floor(SCALE * flat)
            if vectors.size and np.abs(vectors).max() ** 2 * dims >= 2**53:
                raise ValueError("a component is too large for exact scores")
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), vectors))
            have += n
            if have >= CHUNK_ROWS:
                yield emit()
                seq, held, have = seq + 1, [], 0
        if have:
            yield emit()

    # few full chunks: bounds are tighter and calls of numpy fewer than over the many small splits of an input
    return rows.repartition(max(1, -(-size // CHUNK_ROWS))).mapInArrow(pack, CHUNK)


@dataclass
class Block:
    """Some anchors: the number of their chunk and place in it (their identity), id, label, vector, and a payload for a pass."""

    chunk: np.ndarray
    place: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    extra: np.ndarray


BLOCK = "block long, chunks binary, places binary, ids binary, labels binary, vectors binary, extra binary"
FOUND = "chunk long, place long, id long, best array<struct<slot:int,score:bigint,id:bigint>>"


def blocks_of(anchors: DataFrame, size: int, with_windows: bool) -> DataFrame:
    """Anchors (chunk, place, id, label, vector binary, and scores of their positives) packed into blocks."""
    extra = F.col("scores") if with_windows else F.lit(None).cast("array<bigint>")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, seq, held, have = TaskContext.get().partitionId() << 32, 0, [], 0

        def emit() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            whole = [t.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c in range(4)]
            windows = np.full((t.num_rows, POSITIVES), NONE)
            for i, own in enumerate(t.column(5).to_pylist()):
                windows[i, : len(own or [])] = own or []
            values = [*whole, b"".join(t.column(4).to_pylist()), windows.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([base + seq], pa.int64()), *(pa.array([v], pa.binary()) for v in values)], names=[x.split()[0] for x in BLOCK.split(", ")])

        for batch in batches:
            held.append(batch)
            have += batch.num_rows
            if have >= BLOCK_ANCHORS:
                yield emit()
                seq, held, have = seq + 1, [], 0
        if have:
            yield emit()

    return anchors.select("chunk", "place", "id", "label", "vector", extra.alias("extra")).repartition(max(1, -(-size // BLOCK_ANCHORS))).mapInArrow(pack, BLOCK)


def anchors_of(table: DataFrame, every: int) -> DataFrame:
    """chunk, place, id, label and vector (int32 bytes) of the rows whose id is divisible by ``every``."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                own = np.flatnonzero(ids % every == 0)
                vectors = np.frombuffer(row["vectors"], np.int32).reshape(len(ids), -1) if row["vectors"] else np.zeros((len(ids), 0), np.int32)
                columns = [pa.array(np.full(len(own), row["chunk"]), pa.int64()), pa.array(own, pa.int64()), pa.array(ids[own]), pa.array(labels[own]), pa.array([vectors[i].tobytes() for i in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "place", "id", "label", "vector"])

    return table.select("chunk", "ids", "labels", "vectors").mapInArrow(pick, "chunk long, place long, id long, label long, vector binary")


def top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: higher scores, then smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def positives_in(chunk: Chunk, block: Block, best: list, k: int = POSITIVES) -> None:
    """Enters the rows of a chunk into the k best of the same label of each anchor."""
    low, high = chunk.bounds(block.vectors)
    for label in np.unique(block.labels):
        rows = np.flatnonzero(chunk.labels == label)
        if not len(rows):
            continue
        for i in np.flatnonzero(block.labels == label):
            own = rows[(rows != block.place[i])] if chunk.number == block.chunk[i] else rows
            if not len(own):
                continue
            have = best[i][0]
            # the k-th best lower bound, or the k-th best score so far: what lies below cannot enter
            floor = max(np.partition(low[i, own], -k)[-k] if len(own) >= k else -np.inf, have[k - 1][1] if have is not None and len(have) >= k else -np.inf)
            close = own[high[i, own] >= floor]
            enter(best[i], 0, chunk, close, chunk.scores(close, block.vectors[i].astype(np.float64)), k)


def negatives_in(chunk: Chunk, block: Block, best: list, k: int = NEGATIVES) -> None:
    """Enters the rows of a chunk into the k best of another label inside each window of an anchor."""
    low, high = chunk.bounds(block.vectors)
    for i in range(len(block.ids)):
        other = chunk.labels != block.labels[i]
        for slot, positive in enumerate(block.extra[i]):
            if positive == NONE:
                break
            least, most = -(-LOW * int(positive) // 100), HIGH * int(positive) // 100
            if least > most:
                continue
            have = best[i][slot]
            floor = max(least, have[k - 1][1] if have is not None and len(have) >= k else least)
            # rows surely inside the window raise the floor before anything is scored
            near = np.flatnonzero(other & (high[i] >= floor) & (low[i] <= most))
            sure = low[i, near][high[i, near] <= most]
            if len(sure) >= k:
                near = near[high[i, near] >= np.partition(sure, -k)[-k]]
            scores = chunk.scores(near, block.vectors[i].astype(np.float64))
            inside = (scores >= least) & (scores <= most)
            enter(best[i], slot, chunk, near[inside], scores[inside], k)


def enter(lists: list, slot: int, chunk: Chunk, rows: np.ndarray, scores: np.ndarray, k: int) -> None:
    """The k best of a list and of some scored rows; a list has (slot, score, id)."""
    if len(rows):
        found = [(slot, int(scores[j]), int(chunk.ids[rows[j]])) for j in top(scores, chunk.ids[rows], k)]
        lists[slot] = sorted([*(lists[slot] or []), *found], key=lambda x: (-x[1], x[2]))[:k]


def search(table: DataFrame, blocks: DataFrame, groups: int, step, slots: int, k: int) -> DataFrame:
    """chunk, place, id and the k best rows of each slot, for every anchor that has any.

    Every (block, group) is a key of its own: the block's row first, then the chunks of the group.
    """
    numbers = [r["block"] for r in blocks.select("block").collect()]
    none = F.lit(None).cast("binary")
    left = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("chunk"), *[F.col(c) for c in ("chunks", "places", "ids", "labels", "vectors", "extra")], *[none.alias(c) for c in ("cells", "low", "high")])
    right = table.select(F.explode(F.array(*map(F.lit, numbers)).cast("array<bigint>")).alias("block"), F.pmod(F.xxhash64("chunk"), F.lit(groups)).cast("int").alias("group"), F.lit(1).alias("kind"), "chunk", *[none.alias(c) for c in ("chunks", "places")], "ids", "labels", "vectors", none.alias("extra"), "cells", "low", "high")
    both = left.unionByName(right)
    laid = both.repartition(max(1, len(numbers) * groups), "block", "group").sortWithinPartitions("block", "group", "kind", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = None, []

        def emit() -> Iterator[pa.RecordBatch]:
            own = [i for i, lists in enumerate(best) if any(lists)]
            if own:
                rows = [[{"slot": s, "score": v, "id": d} for lists in best[i] if lists for s, v, d in lists] for i in own]
                kind = pa.list_(pa.struct([("slot", pa.int32()), ("score", pa.int64()), ("id", pa.int64())]))
                yield pa.RecordBatch.from_arrays([pa.array(block.chunk[own]), pa.array(block.place[own]), pa.array(block.ids[own]), pa.array(rows, kind)], names=["chunk", "place", "id", "best"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    if block is not None:
                        yield from emit()
                    whole = [np.frombuffer(row[c], np.int64) for c in ("chunks", "places", "ids", "labels")]
                    n = len(whole[0])
                    block = Block(*whole, np.frombuffer(row["vectors"], np.int32).reshape(n, -1) if row["vectors"] else np.zeros((n, 0), np.int32), np.frombuffer(row["extra"], np.int64).reshape(n, -1))
                    best = [[None] * slots for _ in range(n)]
                else:
                    chunk = Chunk.read(*(row[c] for c in ("chunk", "ids", "labels", "cells", "low", "high", "vectors")))
                    for at in range(0, len(block.ids), 512):  # bounds of 512 anchors at a time
                        part = slice(at, at + 512)
                        step(chunk, Block(*(x[part] for x in (block.chunk, block.place, block.ids, block.labels, block.vectors, block.extra))), best[part], k)
        if block is not None:
            yield from emit()

    found = laid.mapInArrow(run, FOUND)
    # a list for each group at most: the lists of an anchor are few, whatever the rows
    merged = found.groupBy("chunk", "place", "id").agg(F.array_sort(F.flatten(F.collect_list("best")), lambda a, b: F.when(a["slot"] != b["slot"], a["slot"] - b["slot"]).when(a["score"] != b["score"], F.when(a["score"] > b["score"], -1).otherwise(1)).when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0)).alias("best"))
    return merged


def hard_negatives(vectors: DataFrame, every: int = 50, id_col: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors are the rows whose id is divisible by ``every``.

    Rows of ``prepared``'s columns may be given too (id, label, x).
    """
    spark = vectors.sparkSession
    bounded_batches(spark, 10_000, 8 << 20)
    rows = vectors if vectors.columns == ["id", "label", "x"] else prepared(vectors, id_col, label, vector)
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("dims")).first()
    table = materialize(chunks(rows, seen["dims"] or 0, seen["n"]), "vector-file")
    anchors = materialize(anchors_of(table, every), "anchors")
    n = anchors.count()
    cores = spark.sparkContext.defaultParallelism
    many = max(1, -(-n // BLOCK_ANCHORS))
    groups = max(1, min(-(-seen["n"] // CHUNK_ROWS), -(-2 * cores // many)))
    found = search(table, materialize(blocks_of(anchors, n, False), "blocks"), groups, positives_in, 1, POSITIVES)
    positives = materialize(found.select("chunk", "place", "id", F.slice("best", 1, POSITIVES).alias("best")), "positives")
    given = anchors.join(positives.select("chunk", "place", F.transform("best", lambda b: b["score"]).alias("scores")), ["chunk", "place"])
    n2 = positives.count()
    lists = search(table, materialize(blocks_of(given, n2, True), "blocks"), groups, negatives_in, POSITIVES, NEGATIVES)
    of_slot = lists.select("chunk", "place", F.explode(F.transform(F.sequence(F.lit(0), F.lit(POSITIVES - 1)), lambda s: F.struct(s.alias("slot"), F.slice(F.filter("best", lambda b: b["slot"] == s), 1, NEGATIVES).alias("own")))).alias("x"))
    ranked = of_slot.select("chunk", "place", "x.slot", F.posexplode("x.own").alias("pos", "negative"))
    named = positives.select("chunk", "place", F.col("id").alias("anchor_id"), F.posexplode("best").alias("slot", "positive"))
    return named.join(ranked, ["chunk", "place", "slot"]).select(
        "anchor_id",
        F.col("positive.id").alias("positive_id"),
        (F.col("pos") + 1).cast("int").alias("rank"),
        F.col("negative.id").alias("negative_id"),
        F.col("positive.score").alias("positive_score"),
        F.col("negative.score").alias("negative_score"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepared(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"))
    noisy = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(noisy.select("id", "label", "x"))


def sql() -> str:
    """DuckDB SQL of the query."""
    return f"""
WITH rows AS MATERIALIZED (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND NOT coalesce(list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x))), false)),
pairs AS MATERIALIZED (SELECT a.id AS a, a.label AS a_label, r.id AS r, r.label AS r_label, list_inner_product(a.x, r.x)::BIGINT AS score FROM rows a, rows r WHERE a.id % 50 = 0 AND a.id <> r.id),
positives AS (SELECT a, a_label, r AS p, score AS p_score FROM pairs WHERE a_label = r_label QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, r) <= {POSITIVES}),
ranked AS (SELECT p.a, p, p_score, r, score, row_number() OVER (PARTITION BY p.a, p ORDER BY score DESC, r) AS k FROM positives p JOIN pairs n ON n.a = p.a AND n.r_label <> p.a_label AND {LOW} * p_score <= 100 * score AND 100 * score <= {HIGH} * p_score)
SELECT a AS anchor_id, p AS positive_id, k::INT AS rank, r AS negative_id, p_score AS positive_score, score AS negative_score FROM ranked WHERE k <= {NEGATIVES}"""
