"""Connected components of a sparse graph of ids, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelry.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (smallest id of its component) for every id in edges ``a``, ``b``.

    Each round takes the smallest label among the neighbours, then the label of that label.
    Rounds end when no label changes; every round is a written table, so a lost executor
    repeats one round at most.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.where("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node"))
                     .agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        step = written(lower.join(jump, "via", "left").select(
            "node", F.least("via", "far").alias("label"), "old"), "labels")
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            return labels
