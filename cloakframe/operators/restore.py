"""Restoring replaced text from recorded mappings: leftmost-longest, without overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakframe.functions.rewrite import normalize_width, splice
from cloakframe.operators.detect import KEYS
from cloakframe.operators.search import find_literals
from cloakframe.storage import keep

def reverse_mappings(mappings: DataFrame) -> DataFrame:
    """(pattern, original, type) of reversible mappings; of equal patterns the first (rec, idx) counts.

    mappings: original_text, replaced_text, type, strategy, and their record's number and place in it.
    """
    rows = mappings.where("strategy = 'Replace' and replaced_text <> ''")
    return rows.groupBy(F.col("replaced_text").alias("pattern")).agg(F.min_by("original_text", F.struct("rec", "idx")).alias("original"), F.min_by("type", F.struct("rec", "idx")).alias("type"), F.min(F.struct("rec", "idx")).alias("at")).select("pattern", "original", "type", "at.*")


def find_patterns(segments: DataFrame, patterns: DataFrame, normalized: bool = False) -> DataFrame:
    """All places (overlapping ones too) of all patterns; patterns stay a table (see ``search``)."""
    form = (lambda c: normalize_width(F.col(c))) if normalized else F.col
    # of patterns with one form the first counts: in fuzzy search two may look alike
    order = F.struct(*[c for c in ("rec", "idx") if c in patterns.columns], "pattern", "original")
    alike = patterns.select(form("pattern").alias("look"), order.alias("at"), "pattern", "original").groupBy("look").agg(F.min_by(F.struct("pattern", "original"), "at").alias("x"))
    alike = keep(alike, "patterns")
    found = find_literals(segments.select(*KEYS, form("text").alias("__find")), KEYS, "__find", alike)
    return found.join(alike, "look").select(*KEYS, "start", "end", "x.pattern", "x.original")


def leftmost_longest(found: DataFrame) -> DataFrame:
    """For each segment the chosen places, in order."""
    lists = found.groupBy(*KEYS).agg(F.array_sort(F.collect_set(F.struct("start", (-F.col("end")).alias("minus"), "end", "pattern", "original"))).alias("all"))

    def step(acc: Column, x: Column) -> Column:
        return F.when(x["start"] >= acc["at"], F.struct(x["end"].alias("at"), F.concat(acc["out"], F.array(x)).alias("out"))).otherwise(acc)

    start = F.struct(F.lit(0).alias("at"), F.filter("all", lambda x: F.lit(False)).alias("out"))
    return lists.select(*KEYS, F.aggregate("all", start, step, lambda a: a["out"]).alias("hits"))


def restore(segments: DataFrame, patterns: DataFrame, fuzzy: bool = False) -> tuple[DataFrame, DataFrame]:
    """(segments, positions): all patterns put back.

    Fuzzy also matches text whose full-width characters were narrowed, where no exact match stands.
    Positions are in the given text (orig_start) and in the restored one (new_start).
    """
    found = find_patterns(segments, patterns)
    chosen = leftmost_longest(found)
    if fuzzy:
        exact = chosen.select(*KEYS, F.explode_outer("hits").alias("h")).where("h is not null").select(*KEYS, F.col("h.start").alias("start"), F.col("h.end").alias("end"), F.col("h.pattern").alias("pattern"), F.col("h.original").alias("original"))
        loose = find_patterns(segments, patterns, normalized=True).alias("l")
        e = exact.select(*[F.col(k).alias(f"e_{k}") for k in KEYS], F.col("start").alias("s"), F.col("end").alias("e"))
        cond = (F.col("l.start") < F.col("e")) & (F.col("s") < F.col("l.end"))
        for k in KEYS:
            cond = cond & (F.col(f"l.{k}") == F.col(f"e_{k}"))
        chosen = leftmost_longest(exact.unionByName(loose.join(e, cond, "left_anti")))
    edits = F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["original"].alias("replaced")))
    out = segments.join(chosen.withColumn("edits", edits), KEYS, "left")
    restored = out.select(*[c for c in segments.columns if c != "text"], F.when(F.col("edits").isNull(), F.col("text")).otherwise(splice(F.col("text"), F.col("edits"))).alias("text"))

    def shift(acc: Column, h: Column) -> Column:
        row = F.struct(h["start"].alias("orig_start"), (h["start"] + acc["d"]).alias("new_start"), h["pattern"].alias("pattern"), h["original"].alias("original"))
        return F.struct((acc["d"] + F.char_length(h["original"]) - (h["end"] - h["start"])).alias("d"), F.concat(acc["out"], F.array(row)).alias("out"))

    empty = F.expr("cast(array() as array<struct<orig_start:int,new_start:int,pattern:string,original:string>>)")
    moved = F.aggregate("hits", F.struct(F.lit(0).alias("d"), empty.alias("out")), shift, lambda a: a["out"])
    positions = chosen.select(*KEYS, F.explode_outer(moved).alias("p")).where("p is not null").select(*KEYS, "p.*")
    return restored, positions


def restore_in_order(segments: DataFrame, mappings: DataFrame) -> DataFrame:
    """The older way: mappings (replaced_text, original_text, idx) replaced one after the other."""
    packed = mappings.where("replaced_text <> ''").select(F.struct("idx", "replaced_text", "original_text").alias("m")).agg(F.array_sort(F.collect_list("m")).alias("ms"))
    joined = segments.crossJoin(F.broadcast(packed))
    return joined.withColumn("text", F.aggregate("ms", F.col("text"), lambda t, m: F.replace(t, m["replaced_text"], m["original_text"]))).drop("ms")
