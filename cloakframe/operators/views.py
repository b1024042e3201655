"""Views of texts and items: highlight segments and where items stand after rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloakframe.operators.detect import KEYS


def highlight_segments(text: Column, spans: Column) -> Column:
    """Plain and marked pieces of a text: spans by start, longer first, overlapping ones skipped."""
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("minus"), x["end"].alias("end"), x["type"].alias("type"))))
    empty = F.expr("cast(array() as array<struct<text:string,type:string>>)")

    def piece(s: Column, e: Column, t: Column) -> Column:
        return F.when(e > s, F.array(F.struct(F.substring(text, s + 1, e - s).alias("text"), t.alias("type")))).otherwise(empty)

    def step(a: Column, x: Column) -> Column:
        out = F.concat(a["out"], piece(a["at"], x["start"], F.lit(None).cast("string")), piece(x["start"], x["end"], x["type"]))
        return F.when(x["start"] >= a["at"], F.struct(x["end"].alias("at"), out.alias("out"))).otherwise(a)

    return F.aggregate(order, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda a: F.concat(a["out"], piece(a["at"], F.char_length(text), F.lit(None).cast("string"))))


def shifted_positions(items: DataFrame) -> DataFrame:
    """new_start and new_end of items (with ``replaced``) in the rewritten text."""
    delta = F.char_length("replaced") - (F.col("end") - F.col("start"))
    before = F.coalesce(F.sum(delta).over(W.partitionBy(*KEYS).orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return items.withColumn("new_start", F.col("start") + before).withColumn("new_end", F.col("start") + before + F.char_length("replaced"))
