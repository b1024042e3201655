"""Detection: the pattern engine over segments, and flattening of tables into segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.spans import detect_spans
from cloakframe.operators.rules import rules_for

PATTERN_CONFIDENCE = 0.95
SOURCE_RANK = {"Regex": 0, "Dict": 1, "Ner": 2, "Manual": 3}
KEYS = ["file_id", "sheet_index", "row", "col"]


def spread(df: DataFrame) -> DataFrame:
    """A small input that lies in fewer partitions than there are cores, dealt over the cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def segments_of_documents(docs: DataFrame, file_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One segment for each row of a table of texts."""
    return docs.select(F.col(file_id).cast("string").alias("file_id"), F.lit(0).alias("sheet_index"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.col(text).alias("text"))


def segments_of_table(df: DataFrame, row: Column, file_id: str, columns: list[str], header: bool = True) -> DataFrame:
    """Cells of a wide table: row 0 is the header (the column names), data rows count from 1."""
    cells = F.posexplode(F.array(*[F.col(c).cast("string") for c in columns])).alias("col", "text")
    body = df.select(F.lit(file_id).alias("file_id"), F.lit(0).alias("sheet_index"), row.cast("int").alias("row"), cells)
    if not header:
        return body
    names = df.sparkSession.createDataFrame([(file_id, 0, 0, k, c) for k, c in enumerate(columns)], body.schema)
    return names.unionByName(body)


def detect_patterns(segments: DataFrame, language: str = "en", enabled: list[str] | None = None) -> DataFrame:
    """Items of the pattern engine; ord keeps their order in a segment (rule, then position)."""
    given = spread(segments.where("text is not null and text <> ''").select(*KEYS, "text"))
    # an inner explode would push a filter on the spans below them, and all would be worked out three times
    found = detect_spans(given, "text", rules_for(language)).select(*KEYS, F.posexplode_outer("spans").alias("ord", "x")).where("x is not null")
    items = found.select(*KEYS, "ord", "x.start", "x.end", "x.text", "x.type", F.lit("Regex").alias("source"), F.lit(PATTERN_CONFIDENCE).alias("confidence"))
    return items if enabled is None else items.where(F.col("type").isin(enabled))


def with_item_id(items: DataFrame) -> DataFrame:
    """A stable id from an item's place and type."""
    return items.withColumn("item_id", F.sha2(F.concat_ws(":", *KEYS, "start", "end", "type"), 256))
