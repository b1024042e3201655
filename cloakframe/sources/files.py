"""Readers and writers by a file's extension."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloakframe.sources import office, tables, text
from cloakframe.storage import keep

EXTENSIONS = ("txt", "csv", "tsv", "docx", "xlsx")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(segments, errors) of all files of a folder; errors (file_id, error) also has files of other kinds."""
    lines, cells = text.read_txt(spark, path), tables.csv_rows(spark, path)
    paragraphs, sheets = office.read_docx(spark, path), office.read_xlsx(spark, path)
    names = ["file_id", "sheet_index", "row", "col", "text"]
    parts = [text.segments_of_lines(lines.where("error is null")), cells.where("error is null"), office.paragraphs_to_segments(paragraphs), office.cells_to_segments(sheets)]
    segments, errors = parts[0].select(*names), None
    for p in parts[1:]:
        segments = segments.unionByName(p.select(*names))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file_id"))
    unknown = files.where(~F.lower(F.substring_index("file_id", ".", -1)).isin(*EXTENSIONS)).select("file_id", F.lit("a kind of file that is not read").alias("error"))
    errors = unknown
    for p in (lines, cells, paragraphs, sheets):
        errors = errors.unionByName(p.where("error is not null").select("file_id", "error"))
    return segments, errors


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system that Spark reads."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def export(segments: DataFrame, cells: DataFrame | None = None, originals: DataFrame | None = None, encodings: DataFrame | None = None) -> dict[str, DataFrame]:
    """What the files become by extension.

    txt: file_id and text, and with ``encodings`` (file_id, encoding) the bytes in that encoding;
    csv (and tsv): file_id and text; xlsx, with ``cells``: file_id and content; docx, with
    ``originals`` (file_id, content): the same documents with these paragraphs; errors: file_id and
    error of files of other kinds, and of texts that their encoding lacks a character for.
    """
    kind = F.lower(F.substring_index("file_id", ".", -1))
    out = {"txt": tables.to_text(segments.where(kind == "txt")), "csv": tables.to_csv(segments.where(kind.isin("csv", "tsv")))}
    errors = segments.where(~kind.isin(*EXTENSIONS)).select("file_id", F.lit("a kind of file that is not written").alias("error")).distinct()
    if encodings is not None:
        encoded = text.encoded(out["txt"].join(encodings.select("file_id", "encoding"), "file_id", "left"))
        out["txt"] = encoded.where("error is null").drop("error")
        errors = errors.unionByName(encoded.where("error is not null").select("file_id", "error"))
    if cells is not None:
        out["xlsx"] = office.to_xlsx(cells.where(kind == "xlsx"))
    if originals is not None:
        out["docx"] = office.to_docx(segments.where(kind == "docx"), originals)
    return {**out, "errors": errors}


def write_back(files: DataFrame, folder: str) -> DataFrame:
    """file_id and path of the files (file_id, content) written under ``folder``; names that are taken get a number.

    Files are written beside their name and renamed, so a task that is run again leaves whole files.
    """
    name, ext = F.substring_index("file_id", "/", -1), F.regexp_extract(F.substring_index("file_id", "/", -1), r"(\.[^.]*)$", 1)
    base = F.when((ext == "") | (ext == name), name).otherwise(F.left(name, F.char_length(name) - F.char_length(ext)))
    end = F.when(ext == name, "").when(F.lower(ext) == ".xls", ".xlsx").otherwise(ext)
    named = files.select("file_id", base.alias("base"), end.alias("end"))
    taken = F.row_number().over(W.partitionBy("base", "end").orderBy("file_id")) - 1
    number = F.when(taken > 0, F.concat(F.lit("_"), taken)).otherwise("")
    paths = named.select("file_id", F.concat(F.lit(f"{folder.rstrip('/')}/"), "base", F.lit(tables.MARK), number, "end").alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                fs, root = pyarrow.fs.FileSystem.from_uri(quote(folder.rstrip("/"), safe=":/@?&=%"))
                fs.create_dir(root, recursive=True)
                inner = f"{root}/{path.rsplit('/', 1)[1]}"
                part = f"{inner}.{uuid.uuid4().hex}.part"
                with fs.open_output_stream(part) as f:
                    f.write(content)
                fs.move(part, inner)
            yield batch.select(["file_id", "path"])

    return keep(files.select("file_id", "content").join(paths, "file_id").select("file_id", "path", "content").mapInArrow(run, "file_id string, path string"), "written")
