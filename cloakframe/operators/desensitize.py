"""Desensitisation: one value for each entity, written into all its places.

An entity is a (text, type); aliases of a group are one entity.  Values are made once over all
files, from the distinct entities in the order in which they first appear, so the result does not
depend on which worker sees which file.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cloakframe.functions import fakes, rewrite
from cloakframe.model import DEFAULT_STRATEGIES, FALLBACK_STRATEGY, GENERALIZE, MASK, REPLACE
from cloakframe.operators.detect import KEYS
from cloakframe.storage import keep

STRATEGY = "type string, kind string, keep_prefix int, keep_suffix int, style string, consistent boolean"
MAPPING = "original_text string, type string, replaced_text string, strategy string"


class Result(NamedTuple):
    segments: DataFrame
    #: original_text, type, replaced_text, strategy, occurrences, place (of the first)
    mappings: DataFrame
    #: type, n; the row whose type is null is the total
    summary: DataFrame
    #: mappings with those of earlier runs
    state: DataFrame
    #: bucket, n: how far each counter has come
    counters: DataFrame
    #: the mappings of ``state`` that earlier runs did not have
    fresh: DataFrame | None = None


def strategies_table(spark: SparkSession, changes: dict[str, tuple] | None = None, inconsistent: set[str] = frozenset()) -> DataFrame:
    rows = {**DEFAULT_STRATEGIES, **(changes or {})}
    return spark.createDataFrame([(t, *s, t not in inconsistent) for t, s in rows.items()], STRATEGY)


def with_strategy(df: DataFrame, strategies: DataFrame) -> DataFrame:
    """Adds a type's strategy: its own, for custom types that of ``Custom``, else the default."""
    kind, prefix, suffix, style = FALLBACK_STRATEGY
    own = strategies.select(F.col("type").alias("s_type"), "kind", "keep_prefix", "keep_suffix", "style", "consistent")
    fam = strategies.where("type = 'Custom'").select(F.struct("kind", "keep_prefix", "keep_suffix", "style", "consistent").alias("fam"))
    joined = df.join(own, F.col("type") == F.col("s_type"), "left").join(F.broadcast(fam.limit(1)), F.startswith("type", F.lit("Custom:")), "left")
    default = {"kind": kind, "keep_prefix": prefix, "keep_suffix": suffix, "style": style, "consistent": True}
    return joined.select(*df.columns, *[F.coalesce(F.col(c), F.col(f"fam.{c}"), F.lit(v)).alias(c) for c, v in default.items()])


def number_in_bucket(df: DataFrame, bucket: str, order: list[str]) -> DataFrame:
    """Adds k: 0, 1, 2, ... in each bucket by order.

    Range-partitioned by bucket and order: partitions number their own rows and add the counts of
    those before, so one large bucket is spread over many tasks.
    """
    laid = keep(df.repartitionByRange(bucket, *order).withColumn("__part", F.spark_partition_id()), "laid")
    counts = laid.groupBy(bucket, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(bucket, "__part", F.coalesce(F.sum("__n").over(W.partitionBy(bucket).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.row_number().over(W.partitionBy(bucket, "__part").orderBy(*order)) - 1
    numbered = laid.withColumn("__own", own).join(before, [bucket, "__part"])
    return numbered.withColumn("k", (F.col("__own") + F.col("__before")).cast("long")).drop("__own", "__before", "__part")


def entity_values(items: DataFrame, strategies: DataFrame | None, language: str, prior: DataFrame | None = None, aliases: DataFrame | None = None, counters: DataFrame | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(text, type, replaced, strategy) for each entity text, and the counters.

    items: text, type and place (``place``, sortable).  prior: earlier mappings, which win.
    aliases: member, primary, type.  Types that are not consistent draw a new number at each
    occurrence, and the last one counts.  Without strategies the items carry their own (kind,
    keep_prefix, keep_suffix, style), and that of an entity's first place makes its value.
    """
    spark = items.sparkSession
    aliases = aliases if aliases is not None else spark.createDataFrame([], "member string, primary string, type string")
    prior = prior if prior is not None else spark.createDataFrame([], MAPPING)
    counters = counters if counters is not None else spark.createDataFrame([], "bucket string, n long")
    member = aliases.select(F.col("member").alias("text"), "type", "primary")
    first = items.groupBy("text", "type").agg(F.min("place").alias("place"), F.max("place").alias("last"), F.count(F.lit(1)).alias("seen"))
    if strategies is None:
        own_rule = items.groupBy("text", "type").agg(F.min_by(F.struct("kind", "keep_prefix", "keep_suffix", "style"), "place").alias("rule")).select("text", "type", "rule.*", F.lit(True).alias("consistent"))
        first = first.join(own_rule, ["text", "type"])
    texts = first.join(member, ["text", "type"], "left").withColumn("entity", F.coalesce("primary", "text"))
    texts = texts if strategies is None else with_strategy(texts, strategies)
    known = prior.select(F.col("original_text").alias("__t"), F.col("type").alias("__y"), "replaced_text", F.col("strategy").alias("__s"))
    own = texts.join(known, (F.col("text") == F.col("__t")) & (F.col("type") == F.col("__y")), "left").drop("__t", "__y").withColumnsRenamed({"replaced_text": "own", "__s": "own_kind"})
    own = own.join(known, (F.col("entity") == F.col("__t")) & (F.col("type") == F.col("__y")), "left").drop("__t", "__y").withColumnsRenamed({"replaced_text": "ofgroup", "__s": "ofgroup_kind"})
    reuse = F.when(F.col("consistent"), F.coalesce("own", "ofgroup"))
    own = keep(own.withColumn("reused", reuse).withColumn("reused_kind", F.when(F.col("consistent"), F.coalesce("own_kind", "ofgroup_kind"))), "entities")
    # one event for each value to make: the entity's first text, or each occurrence if not consistent
    fresh = own.where("reused is null")
    steady = fresh.where("consistent").groupBy("entity", "type").agg(F.min_by(F.struct("text", "place", "kind", "keep_prefix", "keep_suffix", "style"), "place").alias("x")).select("entity", "type", "x.*")
    loose = items.select("text", "type", "place").join(fresh.where("not consistent").select("text", "type", "entity", "kind", "keep_prefix", "keep_suffix", "style"), ["text", "type"]).select("entity", "type", "text", "place", "kind", "keep_prefix", "keep_suffix", "style")
    events = steady.unionByName(loose).withColumn("bucket", F.when(F.col("kind") == REPLACE, fakes.bucket(F.col("text"), F.col("type"), F.col("style"))))
    counted = number_in_bucket(events.where("bucket is not null"), "bucket", ["place"]).join(counters.withColumnRenamed("n", "used"), "bucket", "left").withColumn("k", F.col("k") + F.coalesce("used", F.lit(0))).drop("used")
    every = counted.unionByName(events.where("bucket is null").withColumn("k", F.lit(0).cast("long")))
    text, kind, t = F.col("text"), F.col("kind"), F.col("type")
    value = (
        F.when(kind == MASK, rewrite.mask_keep(text, F.col("keep_prefix"), F.col("keep_suffix")))
        .when(kind == GENERALIZE, rewrite.generalize(text, t, language))
        .when(F.col("bucket").isNotNull(), fakes.numbered_value(text, t, F.col("style"), F.col("k"), seed))
        .otherwise(fakes.random_value(t, "text", seed))
    )
    made = keep(every.select("entity", "type", "place", "bucket", "k", "kind", value.alias("value")), "values")
    last = made.groupBy("entity", "type").agg(F.max_by("value", "place").alias("value"), F.max_by("kind", "place").alias("value_kind"))
    out = own.join(last, ["entity", "type"], "left").select("text", "type", F.coalesce("reused", "value").alias("replaced"), F.coalesce("reused_kind", "value_kind").alias("strategy"), "entity")
    used = made.where("bucket is not null").groupBy("bucket").agg((F.max("k") + 1).alias("n"))
    return out, used.unionByName(counters).groupBy("bucket").agg(F.max("n").alias("n"))


def primaries(members: DataFrame, by: str = "group") -> DataFrame:
    """(group, primary): the longest member of each alias group, the later one of equals; members: group, member, pos."""
    return members.groupBy(by).agg(F.max_by("member", F.struct(F.char_length("member"), "pos")).alias("primary"))


def top_strategy(mappings: DataFrame) -> DataFrame:
    """One row: the strategy with most occurrences (of equals the first by name); Mask if there are no mappings."""
    n = mappings.groupBy("strategy").agg(F.sum("occurrences").alias("n"))
    return n.agg(F.coalesce(F.min_by("strategy", F.struct(-F.col("n"), "strategy")), F.lit(MASK)).alias("strategy"))


def with_place(items: DataFrame) -> DataFrame:
    return items.withColumn("place", F.struct(*KEYS, "ord"))


def splice_items(segments: DataFrame, items: DataFrame) -> DataFrame:
    """Segments with ``replaced`` written over each item's span; others unchanged."""
    edits = items.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "start", "end", "replaced"))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["replaced"].alias("replaced"))).alias("edits"))
    joined = segments.join(edits, KEYS, "left")
    return joined.select(*[c for c in segments.columns if c != "text"], F.when(F.col("edits").isNull(), F.col("text")).otherwise(rewrite.splice(F.col("text"), F.col("edits"))).alias("text"))


def summary(items: DataFrame) -> DataFrame:
    """Items by type, and the total in the row without a type."""
    return items.rollup("type").agg(F.count(F.lit(1)).alias("n"))


def mapping_table(items: DataFrame) -> DataFrame:
    """Mappings with their occurrences from items with ``replaced`` and ``strategy``."""
    return items.where("replaced is not null").groupBy(F.col("text").alias("original_text"), "type").agg(F.min_by("replaced", "place").alias("replaced_text"), F.min_by("strategy", "place").alias("strategy"), F.count(F.lit(1)).alias("occurrences"), F.min("place").alias("place"))


def desensitize(segments: DataFrame, items: DataFrame, strategies: DataFrame | None = None, language: str = "en", prior: DataFrame | None = None, aliases: DataFrame | None = None, counters: DataFrame | None = None, seed: int = 42) -> Result:
    """Rewrite all items' places; see ``entity_values`` for the state that may be given."""
    spark = segments.sparkSession
    strategies = strategies if strategies is not None else strategies_table(spark)
    placed = keep(with_place(items), "items")  # detection runs once
    values, used = entity_values(placed.select("text", "type", "place"), strategies, language, prior, aliases, counters, seed)
    values = keep(values, "replacements")
    done = placed.join(values, ["text", "type"], "left")
    mappings = mapping_table(done)
    new = values.select(F.col("text").alias("original_text"), "type", F.col("replaced").alias("replaced_text"), "strategy")
    primaries = values.where("entity <> text").groupBy("entity", "type").agg(F.min("replaced").alias("r"), F.min("strategy").alias("s")).select(F.col("entity").alias("original_text"), "type", F.col("r").alias("replaced_text"), F.col("s").alias("strategy"))
    old = prior if prior is not None else spark.createDataFrame([], MAPPING)
    added = new.unionByName(primaries).dropDuplicates(["original_text", "type"])
    fresh = added.join(old, ["original_text", "type"], "left_anti")
    state = old.select("original_text", "type", "replaced_text", "strategy").unionByName(fresh)
    return Result(splice_items(segments, done), mappings, summary(placed), state, used, fresh)


def desensitize_by_template(segments: DataFrame, items: DataFrame, entries: DataFrame, prior: DataFrame | None = None) -> Result:
    """Items whose text is an entry with a replacement get it; earlier mappings hold for the rest."""
    spark = segments.sparkSession
    template = entries.where("replacement is not null").groupBy(F.col("text").alias("t_text")).agg(F.max_by("replacement", "entry_idx").alias("t_value"))
    old = prior if prior is not None else spark.createDataFrame([], MAPPING)
    known = old.select(F.col("original_text").alias("p_text"), F.col("type").alias("p_type"), F.col("replaced_text").alias("p_value"))
    placed = keep(with_place(items), "items")
    done = placed.join(template, F.col("text") == F.col("t_text"), "left").join(known, (F.col("text") == F.col("p_text")) & (F.col("type") == F.col("p_type")), "left")
    done = done.withColumn("replaced", F.coalesce("t_value", "p_value")).withColumn("strategy", F.lit(REPLACE))
    return Result(splice_items(segments, done), mapping_table(done), summary(placed), old, spark.createDataFrame([], "bucket string, n long"))
