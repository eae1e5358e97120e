"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glossaria.llm.common import cut


def connected(edges: DataFrame) -> DataFrame:
    """node, class: the least node of its component, for every node of an edge (a, b).

    A round takes the least label among neighbours, then the label of that label, and ends when none changes.
    Rounds grow with the logarithm of the longest path, not with its length.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("class")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "class"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class").alias("near"))
        hooked = labels.join(near, "node").select("node", F.least("class", "near").alias("class"), F.col("class").alias("before"))
        roots = labels.select(F.col("node").alias("class"), F.col("class").alias("root"))
        jumped = cut(hooked.join(roots, "class").select("node", F.least("class", "root").alias("class"), "before"))
        labels = jumped.select("node", "class")
        if jumped.where(F.col("class") != F.col("before")).isEmpty():
            return labels
