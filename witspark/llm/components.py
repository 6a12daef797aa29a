"""Connected components of an edge table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from witspark.plans.lineage import cut


def connected(edges: DataFrame) -> DataFrame:
    """`node`, `comp` (smallest node it reaches) for every node of `edges` (`a`, `b`).

    Each round takes the smallest label among the neighbours and then the label of
    that label, so the rounds grow with the logarithm of a component's width. A
    node with very many edges is one key of an aggregation that combines before
    its shuffle. Lineage is cut by a reliable checkpoint per round.
    """

    both = cut(edges.select("a", "b").union(edges.select("b", "a")).filter("a != b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("comp")))
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), "comp"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("comp").alias("near"))
        )
        lower = labels.join(near, "node").select(
            "node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp")
        )
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        moved = cut(
            lower.join(jump, "comp").select(
                "node", "was", F.least("comp", "next").alias("comp")
            )
        )
        if moved.filter("was != comp").isEmpty():
            return moved.select("node", "comp")
        labels = moved.select("node", "comp")
