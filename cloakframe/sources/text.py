"""Text sources: whole files of known or guessed encoding, and pasted text, as paragraphs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of an input file and of pasted text.
MAX_FILE_BYTES = 50 * 1024 * 1024
MAX_PASTED = 100_000


def lines(texts: DataFrame) -> DataFrame:
    """file_id, row, text of each line; blank lines stay, a last empty one does not."""
    parts = F.split("text", "\r?\n", -1)
    whole = F.when(F.endswith("text", F.lit("\n")) | (F.col("text") == ""), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return texts.select("file_id", F.posexplode(whole).alias("row", "text"))


def segments_of_lines(texts: DataFrame) -> DataFrame:
    return lines(texts).select(F.col("file_id").cast("string").alias("file_id"), F.lit(0).alias("sheet_index"), "row", F.lit(0).alias("col"), "text")


def decode(raw: bytes) -> tuple[str | None, str | None, str | None]:
    """(text, encoding, error): UTF-8 with or without mark, else GBK, else an error."""
    if raw.startswith(b"\xef\xbb\xbf"):
        raw = raw[3:]
    for encoding in ("utf-8", "gbk"):
        try:
            return raw.decode(encoding), encoding, None
        except UnicodeDecodeError:
            pass
    return None, None, "the file is neither UTF-8 nor GBK"


def encoded(texts: DataFrame) -> DataFrame:
    """file_id, text, content and error of texts (file_id, text, encoding): UTF-8 unless the encoding is GBK, which must have every character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, errors = [], []
            for t, encoding in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                try:
                    content.append((t or "").encode("gbk" if encoding == "gbk" else "utf-8"))
                    errors.append(None)
                except UnicodeEncodeError:
                    content.append(None)
                    errors.append("GBK lacks a character of the text; write it as UTF-8")
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(content, pa.binary()), pa.array(errors, pa.string())], names=["file_id", "text", "content", "error"])

    return texts.select("file_id", "text", "encoding").mapInArrow(run, "file_id string, text string, content binary, error string")


def read_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """file_id, content of the files of a folder; larger ones get an error instead of content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    big = F.col("length") > MAX_FILE_BYTES
    return files.select(F.col("path").alias("file_id"), F.when(~big, F.col("content")).alias("content"), F.when(big, "the file is larger than 50 MB").alias("error"))


def read_txt(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """file_id, text, encoding, error of text files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                text, encoding, error = (None, None, r["error"]) if r["content"] is None else decode(r["content"])
                out.append({"file_id": r["file_id"], "text": text, "encoding": encoding, "error": error})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(c, pa.string()) for c in ("file_id", "text", "encoding", "error")]))

    return read_files(spark, path, glob).mapInArrow(run, "file_id string, text string, encoding string, error string")


def pasted(spark: SparkSession, text: str) -> DataFrame:
    """Segments of pasted text."""
    if len(text) > MAX_PASTED:
        raise ValueError(f"pasted text has more than {MAX_PASTED} characters")
    return segments_of_lines(spark.createDataFrame([("clipboard", text)], "file_id string, text string"))
