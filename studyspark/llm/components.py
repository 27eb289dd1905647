"""Connected components of a graph given as edges, by iterative minimum labels in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import Kept


def components(edges: DataFrame, keep: Kept) -> DataFrame:
    """``node, label`` (and ``old``) for every node of ``edges`` (a, b; both bigint): label is the component's smallest node.

    Each round takes the least label of all neighbours and then the label of one's label, so that long chains shrink by
    doubling. Labels are summed up per task before each shuffle, so a node with very many neighbours costs one row per task.
    Every round's labels are written to the shared folder; lost executors cost no earlier round, and the round before is removed.
    Labels only ever fall, so the rounds come to an end. Edges to oneself are allowed.
    """
    e = edges.select("a", "b").dropna()
    both = keep(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).dropDuplicates(["a", "b"]), "edges")
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumn("old", F.col("label")), "labels")
    while True:
        neighbours = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("least"))
        better = labels.drop("old").join(neighbours, labels.node == neighbours.n).select(
            "node", F.col("label").alias("old"), F.least("label", "least").alias("label")
        )
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("further"))
        after = keep(
            better.join(jump, better.label == jump.via, "left").select(
                "node", "old", F.least("label", F.coalesce("further", "label")).alias("label")
            ),
            "labels",
        )
        keep.free(labels)
        labels = after
        if after.where(F.col("old") != F.col("label")).isEmpty():
            keep.free(both)
            return after
