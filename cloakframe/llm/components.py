"""Connected components by label propagation with pointer jumping, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): label is the least node it is linked with.

    A round takes the least label among a node's neighbours and then follows the label's own label,
    so paths halve; it ends with the round that changes nothing.  Every round is written to the
    shared folder, so lineage stays short.  No edges give no rows.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        old = labels.select("node", F.col("label").alias("old"))
        lower = old.join(near, old.node == near.a, "left").select("node", "old", F.least("old", F.coalesce("m", "old")).alias("label"))
        ahead = labels.select(F.col("node").alias("at"), F.col("label").alias("next"))
        new = materialize(lower.join(ahead, lower.label == ahead["at"], "left").select("node", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        labels = new.select("node", "label")
        if not new.where("old <> label").limit(1).count():
            return labels
