"""Connected components by minimum labels with pointer jumping, over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm import scratch


def connected(edges: DataFrame) -> DataFrame:
    """(v, c) for every vertex of edges (a, b): c is the smallest vertex of its component.

    Each round takes the least label among neighbours and then the label of that label, so that long chains
    shrink by halves; rounds end when no label changed. Every round is written to the shared folder, which
    cuts lineage; sums go through partial aggregation, and joins on a hub are sort-merge joins that adaptive
    execution can split.
    """
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = scratch.written(both, "cc-edges")
    table = scratch.written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("c")).withColumnRenamed("a", "v"), "cc-0")
    labels = table
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("v").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("c"))
        least = labels.withColumnRenamed("c", "old").join(near.withColumnRenamed("a", "v"), "v").select("v", "old", F.least("old", "c").alias("c"))
        jumped = least.join(labels.select(F.col("v").alias("c"), F.col("c").alias("up")), "c", "left").select("v", "old", F.least("c", F.coalesce("up", "c")).alias("c"))
        after = scratch.written(jumped, f"cc-{step}")
        done = after.where("old <> c").isEmpty()
        scratch.drop(table)
        table, labels = after, after.select("v", "c")
        if done:
            scratch.drop(both)
            labels._panelyard_path = after._panelyard_path
            return labels
