"""The main path: segments to items to rewritten segments, with or without a workspace."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.operators import desensitize, detect, dictionary, entities, merge
from cloakframe.plans.catalog import Conflict
from cloakframe.plans.workspace import Workspace, columns_of
from cloakframe.storage import keep

MAPPING_COLUMNS = columns_of("mappings")


@dataclass
class Options:
    language: str = "en"
    enabled: list[str] | None = None
    #: 'auto': the built-in dictionary is used only beside a user's own; True or False decide.
    builtin_dictionary: bool | str = "auto"
    backend: object = None
    strategies: dict = field(default_factory=dict)
    inconsistent: set = field(default_factory=set)
    seed: int = 42


def find_items(segments: DataFrame, options: Options, user_entries: DataFrame | None = None, whitelist: DataFrame | None = None) -> DataFrame:
    """Items of all engines, merged and filtered."""
    spark = segments.sparkSession
    parts = [detect.detect_patterns(segments, options.language), entities.detect_entities(segments, options.backend)]
    entries = user_entries if user_entries is not None else spark.createDataFrame([], dictionary.ENTRY)
    own = entries.limit(1).count() > 0
    if options.builtin_dictionary is True or (options.builtin_dictionary == "auto" and own):
        entries = entries.unionByName(dictionary.builtin_entries(spark, options.language, 1_000_000))
        own = True
    if own:
        parts.append(dictionary.detect_dictionary(segments, entries, options.language).drop("entry_idx"))
    items = parts[0]
    for p in parts[1:]:
        items = items.unionByName(p)
    items = merge.merge_no_overlap(items)
    if whitelist is not None:
        items = merge.apply_whitelist(items, whitelist)
    return merge.apply_enabled(items, options.enabled)


#: Runs that start again because another writer committed meanwhile.
TRIES = 10


def run(segments: DataFrame, options: Options | None = None, workspace: Workspace | None = None, file_name: str = "", batch: tuple[str, int] | None = None) -> desensitize.Result:
    """Detect and rewrite; a workspace gives and keeps mappings, counters, aliases and lists.

    All of a run's state is one commit.  A run that loses against another writer starts again from
    that writer's state, so no value is given to two texts.  batch (stream, number) is kept with it.
    """
    options = options or Options()
    for k in range(TRIES):
        base = workspace.snapshot() if workspace else None
        state = {t: workspace.read(t, base) for t in ("mappings", "counters", "aliases", "whitelist", "dictionary")} if workspace else {}
        items = keep(find_items(segments, options, state.get("dictionary"), state.get("whitelist")), "items")
        table = desensitize.strategies_table(segments.sparkSession, options.strategies, options.inconsistent)
        done = desensitize.desensitize(segments, items, table, options.language, state.get("mappings"), state.get("aliases"), state.get("counters"), options.seed)
        if not workspace:
            return done
        changes, meta = workspace.record_changes(base, uuid.uuid4().hex, file_name, done.mappings)
        changes |= {"mappings": ("append", done.fresh.select(*MAPPING_COLUMNS)), "counters": ("replace", done.counters)}
        if batch:
            meta["batches"] = {**base.batches, batch[0]: batch[1]}
        try:
            workspace.log.commit(base, changes, **meta)
            return done
        except Conflict:
            if k == TRIES - 1:
                raise
    raise Conflict(file_name)


def file_report(segments: DataFrame, items: DataFrame) -> DataFrame:
    """Items and segments of each file of a batch."""
    n = items.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_items"))
    return segments.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_segments")).join(n, "file_id", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))


def batch_report(files: DataFrame, by: str = "batch") -> DataFrame:
    """Files (batch, status) of each batch that are done, failed and open, and their number."""
    s = F.col("status")
    return files.groupBy(by).agg(F.count_if(s == "done").alias("done"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "open").alias("open"), F.count(F.lit(1)).alias("total"))
