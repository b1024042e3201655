"""Importance resampling towards a target: hashed n-gram counts by DuckDB in each partition, merged by Spark.

In a task, DuckDB splits texts into words, unnests them, windows them into n-grams and counts
``zlib.crc32(n-gram) % buckets`` with a registered function.  The counts of each row are spilled to
Parquet in the shared folder, once; Spark sums them over all rows (a table of ``buckets`` rows) and
scores every row from the spilled counts.  The log ratio of the target's and the corpus' share of a
bucket is its gain, a row's weight is the mean gain of its n-grams, and Gumbel noise from a hash of
doc_id turns "highest scores" into sampling without replacement in proportion to exp(weight).

Defined results: a null text has no words, weight 0 and the noise alone as its score; a null doc_id
is hashed as an empty one and comes after the others among equal scores; rows that repeat a doc_id
are rows of their own with equal noise; an empty table gives no rows, an empty target gives gains
that only depend on the corpus.  Long texts are counted in pieces that overlap by the words of an
n-gram, so the memory of DuckDB does not follow the length of a text.  Other columns are kept in
``rest``, so no name can clash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, materialize, ranked

BUCKETS, GRAMS = 10_000, 2
PERCENT, MIN_WORDS, SEED = 25, 20, 7
#: Bytes of text in one DuckDB query, and its memory.
RUN_BYTES, MEMORY = 2 << 20, "400MB"
_SEPARATOR = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def count_sql(grams: int) -> str:
    """k, b, n of the table ``part`` (k, skip, text); bucket -1 counts words; n-grams wholly in the first ``skip`` words count not."""
    ahead = "".join(f", lead(w, {g}) OVER x AS w{g}" for g in range(1, grams))
    features = " UNION ALL ".join(f"SELECT k, {' || chr(32) || '.join(f'w{j}' for j in range(g + 1))} AS f FROM win WHERE w{g} IS NOT NULL AND i + {g} > skip" for g in range(grams))
    return f"""
WITH cut AS (SELECT k, skip, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM part),
words AS (SELECT k, skip, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM cut),
win AS (SELECT k, skip, i, w AS w0{ahead} FROM words WINDOW x AS (PARTITION BY k ORDER BY i)),
grams AS ({features})
SELECT k, crc_bucket(f) AS b, sum(n)::BIGINT AS n FROM (SELECT k, f, count(*) AS n FROM grams GROUP BY k, f) GROUP BY k, b
UNION ALL SELECT k, -1 AS b, count(*) AS n FROM words WHERE i > skip GROUP BY k
ORDER BY k, b"""


class Counter:
    """A DuckDB connection of one task that counts the n-grams of texts by bucket."""

    def __init__(self, buckets: int, grams: int):
        import duckdb

        self.grams, self.sql = grams, count_sql(grams)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})

        def crc(features: pa.Array) -> pa.Array:
            whole = features.combine_chunks() if isinstance(features, pa.ChunkedArray) else features
            codes = np.fromiter(map(zlib.crc32, whole.cast(pa.binary()).to_pylist()), np.uint32, len(whole))
            return pa.array((codes % np.uint32(buckets)).astype(np.int32))

        self.db.create_function("crc_bucket", crc, ["VARCHAR"], "INTEGER", type="arrow")

    def count(self, texts: list[bytes], skip: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the text, bucket or -1, n), by index and bucket."""
        part = pa.table({"k": pa.array(range(len(texts)), pa.int32()), "skip": pa.array(skip, pa.int32()), "text": pa.array(texts, pa.binary()).cast(pa.string())})
        self.db.register("part", part)
        found = self.db.sql(self.sql).to_arrow_table()
        self.db.unregister("part")
        return tuple(found[c].to_numpy().astype(np.int64) for c in ("k", "b", "n"))

    def long_text(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(bucket or -1, n) of one text, piece by piece; a piece repeats the last words of the one before."""
        total: dict[int, int] = {}
        for piece, skip in pieces(text, RUN_BYTES, self.grams - 1):
            _, b, n = self.count([piece], [skip])
            for x, y in zip(b.tolist(), n.tolist()):
                total[x] = total.get(x, 0) + y
        keys = sorted(total)
        return np.array(keys, np.int64), np.array([total[x] for x in keys], np.int64)


def pieces(text: bytes, size: int, carry: int) -> Iterator[tuple[bytes, int]]:
    """(piece, words that it repeats): cuts stand at the first separator after ``size`` bytes."""
    at, words = 0, []
    while at < len(text):
        cut = _SEPARATOR.search(text, at + size)
        end = cut.start() if cut else len(text)
        own = text[at:end]
        yield b" ".join([*words, own]), len(words)
        if carry:
            found = [x for x in _SEPARATOR.split(own) if x]
            words = [*words, *found][-carry:]
        at = end


def counted(docs: DataFrame, buckets: int = BUCKETS, grams: int = GRAMS) -> DataFrame:
    """rest (the columns but ``text``), n_words, n_features and the buckets ``at`` with their counts ``n``, of every row."""
    bounded_batches(docs.sparkSession)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"] or [F.lit(0).alias("none")]
    own = docs.select("text", F.struct(*rest).alias("rest"))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:  # a small input in fewer splits than there are cores
        own = own.repartition(cores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(buckets, grams)

        def flush(rows: list, texts: list[bytes]) -> pa.RecordBatch:
            k, b, n = counter.count(texts, [0] * len(texts))
            return packed(pa.concat_arrays(rows), len(texts), k, b, n)

        for batch in batches:
            texts = [(t or b"") for t in batch.column(0).cast(pa.binary()).to_pylist()]
            rows, held, size = [], [], 0
            for i, text in enumerate(texts):
                if len(text) > RUN_BYTES:
                    b, n = counter.long_text(text)
                    yield packed(batch.column(1).slice(i, 1), 1, np.zeros(len(b), np.int64), b, n)
                    continue
                rows.append(batch.column(1).slice(i, 1))
                held.append(text)
                size += len(text)
                if size > RUN_BYTES:
                    yield flush(rows, held)
                    rows, held, size = [], [], 0
            if rows:
                yield flush(rows, held)

    kind = own.schema["rest"].dataType.simpleString()
    return own.mapInArrow(run, f"rest {kind}, n_words long, n_features long, at array<int>, n array<int>")


def packed(rest: pa.Array, rows: int, k: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """The counts (row, bucket, n) as one list for each row."""
    words = np.bincount(k[b < 0], n[b < 0], rows).astype(np.int64)
    k, b, n = k[b >= 0], b[b >= 0], n[b >= 0]
    offsets = pa.array(np.searchsorted(k, np.arange(rows + 1)), pa.int32())
    total = np.bincount(k, n, rows).astype(np.int64)
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (b, n)]
    return pa.RecordBatch.from_arrays([rest, pa.array(words), pa.array(total), *lists], names=["rest", "n_words", "n_features", "at", "n"])


def totals(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows by bucket; what reaches the driver has ``buckets`` rows at most."""
    pairs = counts.select(F.explode(F.arrays_zip("at", "n")).alias("x"))
    out = np.zeros(buckets, np.int64)
    for r in pairs.groupBy("x.at").agg(F.sum("x.n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each bucket, in doubles."""
    s, t, b = corpus.astype(np.float64), target.astype(np.float64), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def weighed(counts: DataFrame, gain: np.ndarray) -> DataFrame:
    """rest, n_words, n_features and weight: the floored mean gain of a row's features."""
    shared = counts.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (3, 4))
            sums = np.concatenate([[0], np.cumsum(shared.value[at] * n.astype(np.int64))])
            ends = np.concatenate([[0], np.cumsum(batch.column(3).value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            features = batch.column(2).to_numpy(zero_copy_only=False)
            weight = (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(features, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], names=["rest", "n_words", "n_features", "weight"])

    kind = counts.schema["rest"].dataType.simpleString()
    return counts.mapInArrow(run, f"rest {kind}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln(u))) with u from the first 32 bits of sha256(seed:doc_id)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS, grams: int = GRAMS) -> DataFrame:
    """rest, n_words, n_features, weight, score and rank (null if not drawn) of every row of docs (doc_id, text, ...).

    Of the N rows with at least ``min_words`` words, floor(percent N / 100) are drawn.
    """
    counts = materialize(counted(docs, buckets, grams), "bucket-counts")
    wanted = totals(counted(target.select("text"), buckets, grams), buckets)
    scored = materialize(weighed(counts, gains(totals(counts, buckets), wanted)).withColumn("score", F.col("weight") + noise(F.col("rest.doc_id"), seed)), "scores")
    pool = scored.where(F.col("n_words") >= min_words)
    quota = percent * pool.count() // 100
    placed = ranked(pool, [F.desc("score"), F.asc_nulls_last("rest.doc_id"), F.desc("n_features")])
    drawn = placed.withColumn("rank", F.when(F.col("place") <= quota, F.col("place"))).drop("place")
    return drawn.unionByName(scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("rest.doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


#: CRC-32 in SQL: the table of 256 values by its rule (polynomial 0xEDB88320), then a fold over a feature's bytes.
_TABLE = "list_transform(range(0, 256), lambda v: list_reduce(list_prepend(v, range(0, 8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def sql() -> str:
    """DuckDB SQL of the query."""

    def part(name: str, table: str, key: str) -> str:
        return f"""{name}_w AS MATERIALIZED (SELECT k, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM (
  SELECT {key} AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM {table})),
{name}_f AS MATERIALIZED (SELECT k, f, count(*) AS n FROM (
  SELECT k, w AS f FROM {name}_w UNION ALL SELECT k, w || ' ' || v FROM (SELECT k, w, lead(w) OVER (PARTITION BY k ORDER BY i) AS v FROM {name}_w) WHERE v IS NOT NULL) GROUP BY k, f)"""

    return f"""
WITH {part("d", "documents", "doc_id")},
{part("b", "benchmark", "item_id")},
codes AS MATERIALIZED (SELECT f, {_CRC} % {BUCKETS} AS slot FROM (SELECT f FROM d_f UNION SELECT f FROM b_f), (SELECT {_TABLE} AS t)),
d_b AS MATERIALIZED (SELECT k, slot, sum(n)::BIGINT AS n FROM d_f JOIN codes USING (f) GROUP BY k, slot),
s AS (SELECT slot, sum(n)::BIGINT AS s FROM d_b GROUP BY slot),
t AS (SELECT slot, sum(n)::BIGINT AS t FROM b_f JOIN codes USING (f) GROUP BY slot),
gains AS (SELECT slot, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + {BUCKETS})::DOUBLE)))::BIGINT AS g FROM s LEFT JOIN t USING (slot)),
weights AS (SELECT k, sum(n)::BIGINT AS n_features, floor(sum(n * g)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM d_b JOIN gains USING (slot) GROUP BY k),
sizes AS (SELECT k, count(*) AS n_words FROM d_w GROUP BY k),
scored AS (SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(n_words, 0) AS n_words,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0))))::BIGINT AS score
  FROM documents LEFT JOIN weights ON k = doc_id LEFT JOIN sizes s ON s.k = doc_id),
places AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END::BIGINT AS rank FROM scored LEFT JOIN places USING (doc_id)"""
