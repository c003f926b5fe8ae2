"""Distributed connected components by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Label every vertex of an undirected edge list with the smallest vertex it reaches.

    Returns ``node, label, was``, a materialised table. Null ends and loops carry no link; repeated edges
    count once. Every round takes the least label among the neighbours (a
    grouped minimum, combined before the shuffle, so that a hub with a third of
    all edges is no hot key) and then jumps to the label's label. Rounds are
    written to the shared folder, and the round before is removed; the loop ends
    when no label changes.
    """
    half = edges.select(F.col(left).alias("node"), F.col(right).alias("peer")).where("node <> peer")
    both = materialise(half.union(half.select("peer", "node")).distinct(), "cc-edges")
    labels = materialise(both.groupBy("node").agg(F.min("peer").alias("m")).select("node", F.least("node", "m").alias("label")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("peer"), "label"), "peer").groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.select("node", "label").join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        lower = materialise(lower, "cc-lower")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        before, labels = labels, materialise(
            lower.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("next", "label")).alias("label")), "cc-labels"
        )
        changed = labels.where("label <> was").limit(1).count()
        discard(before, lower)
        if not changed:
            discard(both)
            return labels
