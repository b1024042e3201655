"""Detection on a stream, and rewriting batch by batch with a workspace's state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cloakframe.functions.spans import detect_spans
from cloakframe.operators.desensitize import splice_items, with_place
from cloakframe.operators.rules import rules_for
from cloakframe.plans.pipeline import Options, find_items, run
from cloakframe.plans.workspace import Workspace
from cloakframe.storage import keep


def spans_on_stream(stream: DataFrame, text: str = "text", language: str = "en") -> DataFrame:
    """Detection has no state: the spans of each row as it comes."""
    return detect_spans(stream, text, rules_for(language))


def windowed_counts(stream: DataFrame, time: str, text: str = "text", language: str = "en", late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Items by type and time window; rows later than ``late`` are left out."""
    found = spans_on_stream(stream.withWatermark(time, late), text, language).select(time, F.explode_outer("spans").alias("x")).where("x is not null")
    return found.groupBy(F.window(time, width), F.col("x.type").alias("type")).agg(F.count(F.lit(1)).alias("n"))


def rewrite_stream(segments: DataFrame, workspace: Workspace, out: str, checkpoint: str, options: Options | None = None, name: str = "stream") -> StreamingQuery:
    """Rewrite a stream of segments; consistent across batches through the workspace.

    The commit of a batch's state carries its number.  A batch that is run again before that commit
    makes the same values from the same state; after it, its state is left alone and the rows are made
    from it again, so history, counters and mappings have each batch once, and so has the output.
    """

    def one(batch: DataFrame, number: int) -> None:
        rewrite_batch(batch, number, workspace, out, options, name)

    return segments.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rewrite_batch(batch: DataFrame, number: int, workspace: Workspace, out: str, options: Options | None = None, name: str = "stream") -> bool:
    """One batch into ``out/batch=number``; False if the workspace had its state already."""
    given = keep(batch, "batch")
    new = workspace.snapshot().batches.get(name, -1) < number
    done = run(given, options, workspace, f"batch {number}", (name, number)).segments if new else rewrite_with(given, workspace, options)
    done.write.mode("overwrite").parquet(f"{out}/batch={number}")
    return new


def rewrite_with(segments: DataFrame, workspace: Workspace, options: Options | None = None) -> DataFrame:
    """Segments rewritten by the mappings that a workspace has; texts without one stay."""
    options, base = options or Options(), workspace.snapshot()
    items = find_items(segments, options, workspace.read("dictionary", base), workspace.read("whitelist", base))
    known = workspace.read("mappings", base).select(F.col("original_text").alias("text"), "type", F.col("replaced_text").alias("replaced"))
    return splice_items(segments, with_place(items).join(known, ["text", "type"], "left"))
