"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knownat.llm.store import stored


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """Rows (node, label) for every node of the edges (a, b): label is the least node that can be reached.

    Each round a node takes the least label among its own, its neighbours' and its label's label, so paths shrink by
    half or better. Labels are written after each round; the job fails if they still change after `most` rounds.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = stored(both.distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels")
    for _ in range(most):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        step = labels.join(near, labels.node == near.a).join(up, labels.label == F.col("up"), "left")
        step = step.select("node", F.least("label", "near", "up_label").alias("label"), F.col("label").alias("was"))
        step = stored(step, "labels")
        labels = step.select("node", "label")
        if step.where("label < was").isEmpty():
            return labels
    raise ValueError(f"labels still change after {most} rounds")
