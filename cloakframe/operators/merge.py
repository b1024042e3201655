"""Merging of engines, and the filters on items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloakframe.operators.detect import KEYS, SOURCE_RANK

FIELDS = ["start", "end", "text", "type", "source", "confidence"]


def _rank():
    rank = F.lit(9)
    for name, k in SOURCE_RANK.items():
        rank = F.when(F.col("source") == name, k).otherwise(rank)
    return rank


def merge_no_overlap(items: DataFrame) -> DataFrame:
    """One list for each segment: pattern items all stay, then dictionary, then entity items.

    An item that overlaps one already in the list is dropped; a dropped one blocks nothing.  Items are
    swept by their starts: a run of items that reach into one another is decided on its own, so the
    work follows the items, not their square, and a segment with very many is no array.
    """
    by = W.partitionBy(*KEYS).orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    opened = items.withColumn("rank", _rank()).withColumn("__new", F.when(F.col("start") >= reach, 1).when(reach.isNull(), 1).otherwise(0))
    runs = opened.withColumn("__run", F.sum("__new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    lists = runs.groupBy(*KEYS, "__run").agg(F.array_sort(F.collect_list(F.struct("rank", "ord", *FIELDS))).alias("all"))
    base = F.filter("all", lambda x: x["rank"] == 0)

    def admit(kept, x):
        clash = F.exists(kept, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(x)))

    merged = F.when(F.size("all") > 1, F.aggregate(F.filter("all", lambda x: x["rank"] > 0), base, admit)).otherwise(F.col("all"))
    kept = lists.select(*KEYS, F.explode_outer(merged).alias("x")).where("x is not null")
    place = F.row_number().over(W.partitionBy(*KEYS).orderBy("x.rank", "x.ord")) - 1
    return kept.select(*KEYS, place.alias("ord"), *[f"x.{f}" for f in FIELDS])


def append_items(old: DataFrame, new: DataFrame) -> DataFrame:
    """The older way: new items that overlap no old one on row and column; sheets are not told apart."""
    o = old.select(F.col("file_id").alias("f"), F.col("row").alias("r"), F.col("col").alias("c"), F.col("start").alias("s"), F.col("end").alias("e"))
    apart = new.join(o, (new.file_id == o.f) & (new.row == o.r) & (new.col == o.c) & (new.start < o.e) & (o.s < new.end), "left_anti")
    return old.unionByName(apart)


def apply_whitelist(items: DataFrame, whitelist: DataFrame) -> DataFrame:
    """Without items whose text equals an entry; fuzzy entries ignore case."""
    exact = whitelist.where("match_mode = 'Exact'").select(F.col("text").alias("w")).distinct()
    fuzzy = whitelist.where("match_mode <> 'Exact'").select(F.lower("text").alias("w")).distinct()
    return items.join(exact, F.col("text") == F.col("w"), "left_anti").join(fuzzy, F.lower("text") == F.col("w"), "left_anti")


def apply_enabled(items: DataFrame, enabled: list[str] | None) -> DataFrame:
    """Items of the enabled types; ``Custom`` stands for all custom types."""
    if enabled is None:
        return items
    return items.where(F.when(F.startswith("type", F.lit("Custom:")), "Custom").otherwise(F.col("type")).isin(enabled))


def entities_only(ner: DataFrame, others: DataFrame) -> DataFrame:
    """Entity items that overlap no item of the other engines."""
    o = others.select(*[F.col(k).alias(f"o_{k}") for k in KEYS], F.col("start").alias("s"), F.col("end").alias("e"))
    same = [ner[k] == o[f"o_{k}"] for k in KEYS]
    cond = (ner.start < o.e) & (o.s < ner.end)
    for c in same:
        cond = cond & c
    return ner.join(o, cond, "left_anti")


def refresh_dictionary(items: DataFrame, new: DataFrame) -> DataFrame:
    """Dictionary items replaced by those of a new dictionary."""
    return items.where("source <> 'Dict'").unionByName(new.where("source = 'Dict'"))
