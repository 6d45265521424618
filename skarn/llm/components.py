"""Connected components of an undirected graph, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skarn.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``v, label`` for every end of ``edges`` (a, b): the smallest node that can be reached.

    Each round takes the smallest label of the neighbours and then the label of that label, so long
    chains shrink by a factor a round. Rounds are written, so none is computed twice; only the
    number of changed rows goes to the driver. Joins are plain shuffles that Spark splits at hubs.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    both = written(both, "edges")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("label").alias("m"))
        lower = labels.join(near, F.col("v") == F.col("a")).select("v", "label", F.least("label", "m").alias("next"))
        of = labels.select(F.col("v").alias("p"), F.col("label").alias("jump"))
        moved = lower.join(of, F.col("next") == F.col("p"), "left").select("v", "label", F.coalesce(F.least("next", "jump"), "next").alias("next"))
        moved = written(moved, "labels")
        labels = moved.select("v", F.col("next").alias("label"))
        if moved.where("label <> next").isEmpty():
            return labels
