"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; a local folder only where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("cloakframe.shared.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='cloakframe-')}"
        spark.conf.set("cloakframe.shared.dir", base)
    if "://" not in base:
        base = f"file://{base}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet in the shared folder and read back: computed once, and no lineage."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    with brief_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, limit: int) -> DataFrame:
    """A materialized table, marked for broadcast only if it has at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of a finished query are removed at once, not when the driver next collects garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def partitions_for(docs: DataFrame) -> int:
    """Partitions for a shuffle of whole rows: they follow the input's own splits, so their size stays bounded."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())


def bounded_batches(spark: SparkSession, rows: int = 250, size: int = 4 << 20) -> None:
    """Smaller Arrow batches for this session: texts are far longer than the rows the default is made for."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``place``: 1, 2, 3, ... by ``order``, without a task that sees all rows.

    Rows are dealt by ranges; a partition numbers its own rows after the counts of those before it.
    """
    spark = rows.sparkSession
    laid = materialize(rows.repartitionByRange(partitions_for(rows), *order).withColumn("__part", F.spark_partition_id()), "laid")
    sizes, before, at = dict(laid.groupBy("__part").count().collect()), [], 0
    for part in sorted(sizes):
        before.append((part, at))
        at += sizes[part]
    starts = spark.createDataFrame(before, "__part int, __before long")
    own = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return laid.withColumn("place", own).join(F.broadcast(starts), "__part").withColumn("place", F.col("place") + F.col("__before")).drop("__part", "__before")
