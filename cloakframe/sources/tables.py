"""CSV and TSV files as cells, and text sinks."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.model import SEGMENT
from cloakframe.sources.text import decode, read_files


def csv_cells(raw: bytes, delimiter: str) -> list[tuple[int, int, str]]:
    """(row, col, text) of every cell; the first row is the header, rows may differ in length."""
    text, _, error = decode(raw)
    if error:
        raise ValueError(error)
    return [(r, c, x) for r, line in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)) for c, x in enumerate(line)]


def csv_rows(spark: SparkSession, path: str, glob: str = "*.{csv,tsv}") -> DataFrame:
    """Segments of quoted files and ``error``; tabs separate the cells of .tsv files.

    A file that is too large or cannot be read gives one row that has only its name and the error.
    """
    schema = pa.schema([("file_id", pa.string()), ("sheet_index", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("text", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.to_pylist():
                error, cells = f["error"], []
                if error is None:
                    try:
                        cells = csv_cells(f["content"], "\t" if f["file_id"].lower().endswith(".tsv") else ",")
                    except (ValueError, csv.Error) as e:
                        error = str(e)
                if error is not None:
                    yield pa.RecordBatch.from_pylist([{"file_id": f["file_id"], "error": error}], schema=schema)
                for at in range(0, len(cells), 10_000):
                    part = cells[at : at + 10_000]
                    columns = [pa.array(x, t) for x, t in zip(zip(*part), (pa.int32(), pa.int32(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([pa.array([f["file_id"]] * len(part)), pa.array([0] * len(part), pa.int32()), *columns, pa.nulls(len(part), pa.string())], schema=schema)

    return read_files(spark, path, glob).mapInArrow(run, f"{SEGMENT}, error string")


def read_csv(spark: SparkSession, path: str, glob: str = "*.{csv,tsv}") -> DataFrame:
    """The segments of ``csv_rows``."""
    return csv_rows(spark, path, glob).where("error is null").drop("error")


def read_large_csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """A wide table of strings from files that Spark may split; for files beyond the limit of read_csv."""
    return spark.read.csv(path, header=True, sep=delimiter, inferSchema=False, mode="PERMISSIVE")


def _field(text):
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\r\n]'), quoted).otherwise(text)


def to_csv(segments: DataFrame) -> DataFrame:
    """file_id and text of a comma-separated file for the first sheet of each file."""
    cells = segments.where("sheet_index = 0")
    width = cells.groupBy("file_id").agg(F.max("col").alias("last"))
    lines = cells.groupBy("file_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", _field(F.coalesce("text", F.lit(""))).alias("x")))).alias("m")).join(width, "file_id")
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.col("last")), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(""))), ",")
    return to_text(lines.select("file_id", "row", line.alias("text")))


def to_text(rows: DataFrame) -> DataFrame:
    """file_id and text: the rows of each file joined by line feeds."""
    lists = rows.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("row", "text"))).alias("x"))
    return lists.select("file_id", F.array_join(F.transform("x", lambda r: r["text"]), "\n").alias("text"))


#: Fixed value: what stands before the extension of a file that is written back.
MARK = "_脱敏"


def output_name(path: str, taken: set[str], mark: str = MARK) -> str:
    """base + mark + extension, with _1, _2, ... if taken."""
    folder, _, name = path.rpartition("/")
    base, dot, ext = name.rpartition(".")
    base, ext = (base, dot + ext) if base else (name, "")
    ext = ".xlsx" if ext.lower() == ".xls" else ext
    names = (f"{base}{mark}{n}{ext}" for n in ["", *[f"_{k}" for k in range(1, 1000)]])
    free = next(x for x in (f"{folder}/{n}" if folder else n for n in names) if x not in taken)
    return free
