"""Tables written to the folder that driver and executors share, to compute a step once; and small files there."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; a local folder only where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("cloakframe.work.dir", None)
    if not base:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='cloakframe-')}"
        spark.conf.set("cloakframe.work.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet and read back: computed once, short lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _located(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless it is there; False if another writer was first.

    The text is written beside it and then linked (local and mounted folders) or renamed (file systems
    whose rename refuses an existing target, as HDFS), so a reader never sees a part of it.
    """
    fs, p = _located(spark, path)
    fs.mkdirs(p.getParent())
    temp = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(temp, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            try:
                os.link(temp.toUri().getPath(), p.toUri().getPath())
                return True
            except FileExistsError:
                return False
        return not fs.exists(p) and fs.rename(temp, p)
    finally:
        fs.delete(temp, False)


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _located(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    fs, p = _located(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def modified(spark: SparkSession, path: str) -> float:
    """When a file or folder was last changed, in seconds."""
    fs, p = _located(spark, path)
    return fs.getFileStatus(p).getModificationTime() / 1000


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _located(spark, path)
    fs.delete(p, True)
