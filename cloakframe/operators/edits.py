"""What a user changes in the list of items: a log of edits, and the items that are active after it.

edits: seq, action, id, text, value and the fields of an item.  Actions: ``remove`` (the item with
this id), ``ignore`` (all items with this text; value ``Fuzzy``: whatever its case), ``add`` (a manual
item, which also ends an earlier ``ignore`` of its text), ``strategy`` (value is the item's own
strategy) and ``undo`` (takes back the last remove, add or strategy that is not taken back yet; only
the last ``UNDO_DEPTH`` of them can be).  An undo never takes an ignore back, and an undone add does
not bring one back.  Rows without an action are no edits; an empty log changes nothing.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.operators.detect import KEYS

#: How many edits can be taken back, and files of a queue.
UNDO_DEPTH, QUEUE = 50, 20
#: Strategies that a type may have.
ALLOWED = {"PersonName": ("Replace", "Mask"), "OrgName": ("Replace", "Mask"), "Title": ("Replace", "Mask"), "Address": ("Mask", "Replace", "Generalize")}
ALLOWED_ELSE = ("Mask", "Replace")
FIELDS = ["start", "end", "text", "type", "source", "confidence"]


def effective(edits: DataFrame, by: list[str] | tuple = ("file_id",), depth: int = UNDO_DEPTH) -> DataFrame:
    """The edits of each file that no undo takes back.

    A file's log is read in order as a stream; only the last ``depth`` edits are held, since older
    ones cannot be taken back any more.
    """
    names = edits.columns
    file, action = [names.index(c) for c in by], names.index("action")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, of = deque(), None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key = tuple(row[k] for k in file)
                if key != of:
                    out += stack
                    stack, of = deque(), key
                if row[action] == "undo":
                    if stack:
                        stack.pop()
                elif row[action] == "ignore":
                    out.append(row)
                else:
                    stack.append(row)
                    if len(stack) > depth:
                        out.append(stack.popleft())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), batch.schema.types)], names=names)
        if stack:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*stack), batch.schema.types)], names=names)

    log = edits.where("action is not null").repartition(*by).sortWithinPartitions(*by, "seq")
    return log.mapInArrow(run, edits.schema).select(*by, "seq", *[c for c in names if c not in ("seq", *by)])


def ignored_texts(edits: DataFrame) -> DataFrame:
    """file_id, text and fuzzy of the texts that are ignored at the end: no later manual item has that text."""
    fuzzy = F.coalesce(F.col("value") == "Fuzzy", F.lit(False)) if "value" in edits.columns else F.lit(False)
    marks = edits.where("action = 'ignore'").groupBy("file_id", "text", fuzzy.alias("fuzzy")).agg(F.max("seq").alias("seq"))
    added = edits.where("action = 'add'").groupBy("file_id", "text").agg(F.max("seq").alias("seq"))
    alike = added.groupBy("file_id", F.lower("text").alias("text")).agg(F.max("seq").alias("seq"))

    def left(rows: DataFrame, adds: DataFrame, key: Column) -> DataFrame:
        a = adds.select(F.col("file_id").alias("a_file"), F.col("text").alias("a_text"), F.col("seq").alias("a_seq"))
        return rows.join(a, (F.col("file_id") == F.col("a_file")) & (key == F.col("a_text")) & (F.col("a_seq") > F.col("seq")), "left_anti")

    return left(marks.where("not fuzzy"), added, F.col("text")).unionByName(left(marks.where("fuzzy"), alike, F.lower("text"))).select("file_id", "text", "fuzzy")


def active_items(items: DataFrame, edits: DataFrame) -> DataFrame:
    """Items (with id) less those removed or ignored, with manual ones and each item's own strategy (override)."""
    log = effective(edits)
    gone = log.where("action = 'remove'").select("file_id", "id").distinct()
    ignored = ignored_texts(edits)
    own = log.where("action = 'strategy'").groupBy("file_id", "id").agg(F.max_by("value", "seq").alias("override"))
    names = ["id", *KEYS, *FIELDS]
    added = log.where("action = 'add'").withColumns({"source": F.lit("Manual"), "confidence": F.lit(1.0)}).select(*names)
    every = items.select(*names).unionByName(added).join(gone, ["file_id", "id"], "left_anti")
    every = every.join(ignored.where("not fuzzy").select("file_id", "text"), ["file_id", "text"], "left_anti")
    loose = ignored.where("fuzzy").select("file_id", F.lower("text").alias("__low")).distinct()
    every = every.withColumn("__low", F.lower("text")).join(loose, ["file_id", "__low"], "left_anti").drop("__low")
    return every.join(own, ["file_id", "id"], "left").select(*names, "override")


def without_first(whitelist: DataFrame, texts: DataFrame) -> DataFrame:
    """A whitelist (idx, text, match_mode) without the first entry of each text that is marked by hand."""
    first = whitelist.join(texts.select("text").distinct(), "text").groupBy("text").agg(F.min("idx").alias("idx"))
    return whitelist.join(first, ["text", "idx"], "left_anti").select(*whitelist.columns)


def types_in_order(items: DataFrame) -> DataFrame:
    """The families of the items' types (custom ones are ``Custom``), by first place: type, place."""
    name = F.when(F.startswith("type", F.lit("Custom:")), "Custom").otherwise(F.col("type"))
    return items.groupBy(name.alias("type")).agg(F.min("place").alias("place"))


def is_allowed(type_key: Column, kind: Column) -> Column:
    """Whether a type may have a strategy."""
    allowed = F.create_map(*[x for t, kinds in ALLOWED.items() for x in (F.lit(t), F.array(*map(F.lit, kinds)))])
    return F.array_contains(F.coalesce(F.try_element_at(allowed, type_key), F.array(*map(F.lit, ALLOWED_ELSE))), kind)
