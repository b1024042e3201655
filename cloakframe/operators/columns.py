"""Column operators: what type a column holds, and whole-cell desensitisation with a codebook."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.spans import detect_spans
from cloakframe.model import MASK, TYPES
from cloakframe.operators.desensitize import MAPPING, entity_values
from cloakframe.operators.rules import rules_for
from cloakframe.storage import keep

MAPPING_COLUMNS = [x.split()[0] for x in MAPPING.split(", ")]

SAMPLE_ROWS = 100
MIN_SHARE = 0.3
NER_SHARE = 0.1


def _type_rank(c):
    return F.coalesce(F.array_position(F.array(*[F.lit(t) for t in TYPES]), c), F.lit(999))


def infer_columns(segments: DataFrame, language: str = "en", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """file_id, sheet_index, col, header, inferred_type, confidence, sample_hits, sample_total.

    Looks at the first rows of each sheet.  A cell is a hit if items cover half of it; its type is
    the one that covers most.  A column's type is that of most hits, if hits reach MIN_SHARE of the
    sampled rows; ties go to the type that stands first in the list of types.
    """
    sheet = ["file_id", "sheet_index"]
    data = segments.where((F.col("row") > 0) & (F.col("row") <= sample_rows))
    total = data.groupBy(*sheet).agg(F.count_distinct("row").alias("sample_total"))
    found = detect_spans(data.where("text <> ''"), "text", rules_for(language))
    spans = found.select(*sheet, "row", "col", F.char_length("text").alias("n"), F.explode_outer("spans").alias("x")).where("x is not null")
    by_type = spans.groupBy(*sheet, "row", "col", "n", "x.type").agg(F.sum(F.col("x.end") - F.col("x.start")).alias("covered"))
    cells = by_type.groupBy(*sheet, "row", "col", "n").agg(F.sum("covered").alias("all"), F.min_by("type", F.struct(-F.col("covered"), _type_rank(F.col("type")))).alias("type")).where("all * 2 >= n")
    votes = cells.groupBy(*sheet, "col", "type").agg(F.count(F.lit(1)).alias("hits"))
    best = votes.groupBy(*sheet, "col").agg(F.sum("hits").alias("sample_hits"), F.min_by("type", F.struct(-F.col("hits"), _type_rank(F.col("type")))).alias("best"))
    header = segments.where("row = 0").select(*sheet, "col", F.col("text").alias("header"))
    joined = header.join(total, sheet, "left").join(best, [*sheet, "col"], "left")
    hits, n = F.coalesce("sample_hits", F.lit(0)), F.coalesce("sample_total", F.lit(0))
    confidence = F.when(n > 0, hits / n).otherwise(0.0)
    return joined.select(*sheet, "col", "header", F.when(confidence >= MIN_SHARE, F.col("best")).alias("inferred_type"), confidence.alias("confidence"), hits.cast("long").alias("sample_hits"), n.cast("long").alias("sample_total"))


def infer_columns_from_entities(items: DataFrame, rows: DataFrame) -> DataFrame:
    """Columns where entity items stand in at least NER_SHARE of the rows (file_id, sheet_index, n_rows)."""
    sheet = ["file_id", "sheet_index"]
    counts = items.where("source = 'Ner' and row > 0").groupBy(*sheet, "col", "type").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "ord")).alias("first"))
    best = counts.groupBy(*sheet, "col").agg(F.min_by("type", F.struct(-F.col("n"), "first")).alias("type"))
    hit = items.where("source = 'Ner' and row > 0").groupBy(*sheet, "col").agg(F.count_distinct("row").alias("hit_rows"))
    share = F.col("hit_rows") / F.col("n_rows")
    return hit.join(best, [*sheet, "col"]).join(rows, sheet).where(share >= NER_SHARE).select(*sheet, "col", F.col("type").alias("inferred_type"), share.alias("confidence"))


def merge_inferences(pattern: DataFrame, entity: DataFrame) -> DataFrame:
    """The pattern engine's row, unless it has no type or entities are surer."""
    e = entity.select("file_id", "sheet_index", "col", F.col("inferred_type").alias("e_type"), F.col("confidence").alias("e_confidence"))
    joined = pattern.join(e, ["file_id", "sheet_index", "col"], "full_outer")
    take = F.col("e_type").isNotNull() & (F.col("inferred_type").isNull() | (F.col("e_confidence") > F.col("confidence")))
    return joined.select("file_id", "sheet_index", "col", F.when(take, F.col("e_type")).otherwise(F.col("inferred_type")).alias("inferred_type"), F.when(take, F.col("e_confidence")).otherwise(F.col("confidence")).alias("confidence"))


class ColumnResult(NamedTuple):
    segments: DataFrame
    #: original_text, type, replaced_text, strategy, occurrences
    mappings: DataFrame
    #: file_id, header, type, strategy, original, replaced of the reversible columns
    codebook: DataFrame
    #: mappings with those of earlier runs; first wins
    state: DataFrame
    #: bucket, n: how far each counter has come
    counters: DataFrame
    #: the mappings of ``state`` that earlier runs did not have
    fresh: DataFrame


def desensitize_columns(segments: DataFrame, rules: DataFrame, language: str = "en", prior: DataFrame | None = None, aliases: DataFrame | None = None, counters: DataFrame | None = None, seed: int = 42) -> ColumnResult:
    """Whole cells of the ruled columns rewritten, header and empty cells untouched.

    rules: sheet_index, col, type, kind, keep_prefix, keep_suffix, style, reversible.  The codebook
    has the changed values of reversible columns; a mask is never reversible.  A value is made by the
    rule of the first cell (sheet, column, row) with its text and type, and holds for the others too.
    ``prior`` and ``counters`` are the state of earlier runs: a text that has a mapping keeps it, and
    numbers go on from the counters, so no two texts get one value.
    """
    spark = segments.sparkSession
    ruled = segments.where("row > 0 and text <> ''").join(rules, ["sheet_index", "col"])
    cells = ruled.select("text", "type", "kind", "keep_prefix", "keep_suffix", "style", F.struct("file_id", "sheet_index", "col", "row").alias("place"))
    values, used = entity_values(cells, None, language, prior, aliases, counters, seed)
    values = keep(values, "column-values")
    new = ruled.join(values.select("text", "type", "replaced", "strategy"), ["text", "type"])
    changed = new.where("replaced <> text")
    out = segments.join(new.select("file_id", "sheet_index", "row", "col", "replaced"), ["file_id", "sheet_index", "row", "col"], "left").withColumn("text", F.coalesce("replaced", "text")).drop("replaced")
    mappings = changed.groupBy(F.col("text").alias("original_text"), "type").agg(F.min("replaced").alias("replaced_text"), F.min("strategy").alias("strategy"), F.count(F.lit(1)).alias("occurrences"))
    header = segments.where("row = 0").select("file_id", "sheet_index", "col", F.col("text").alias("header"))
    book = changed.where((F.col("kind") != MASK) & F.col("reversible")).join(header, ["file_id", "sheet_index", "col"]).select("file_id", "header", "type", F.col("kind").alias("strategy"), F.col("text").alias("original"), "replaced").distinct()
    old = (prior if prior is not None else spark.createDataFrame([], MAPPING)).select(*MAPPING_COLUMNS)
    made = values.select(F.col("text").alias("original_text"), "type", F.col("replaced").alias("replaced_text"), "strategy")
    # the value of a group's primary is kept too, for members that come later
    groups = values.where("entity <> text").groupBy("entity", "type").agg(F.min("replaced").alias("replaced_text"), F.min("strategy").alias("strategy")).select(F.col("entity").alias("original_text"), "type", "replaced_text", "strategy")
    fresh = made.unionByName(groups).dropDuplicates(["original_text", "type"]).join(old, ["original_text", "type"], "left_anti")
    return ColumnResult(out, mappings, book, old.unionByName(fresh), used, fresh)


PLACE = ["file_id", "sheet_index", "row", "col"]


def merge_column(segments: DataFrame, redone: DataFrame, columns: DataFrame) -> DataFrame:
    """Segments with the cells of the given columns (file_id, sheet_index, col) taken from a second run."""
    new = redone.join(columns, ["file_id", "sheet_index", "col"], "left_semi").where("row > 0").select(*PLACE, F.col("text").alias("__new"), F.lit(True).alias("__redone"))
    return segments.join(new, PLACE, "left").withColumn("text", F.when(F.col("__redone"), F.col("__new")).otherwise(F.col("text"))).drop("__new", "__redone")


def merge_mappings(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each (original_text, replaced_text): that of the earlier run, with the occurrences of both."""
    names = ["original_text", "type", "replaced_text", "strategy"]
    both = old.select(*names, "occurrences", F.lit(0).alias("run")).unionByName(new.select(*names, "occurrences", F.lit(1).alias("run")))
    first = F.min_by(F.struct("type", "strategy"), F.struct("run", "type", "strategy")).alias("x")
    return both.groupBy("original_text", "replaced_text").agg(first, F.sum("occurrences").alias("occurrences")).select("original_text", "x.type", "replaced_text", "x.strategy", "occurrences")


def undo_column(segments: DataFrame, original: DataFrame, mappings: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, mappings) with the given columns as they were.

    Mappings that only those columns used go; the others count the cells that still hold them.
    """
    back = merge_column(segments, original, columns)
    before = original.select(*PLACE, F.col("text").alias("original_text"))
    cells = back.where("row > 0").select(*PLACE, F.col("text").alias("replaced_text")).join(before, PLACE).where("original_text <> replaced_text")
    left = cells.groupBy("original_text", "replaced_text").agg(F.count(F.lit(1)).alias("occurrences"))
    return back, mappings.drop("occurrences").join(left, ["original_text", "replaced_text"])
