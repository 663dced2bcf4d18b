"""Connected components by least-label propagation with pointer jumping, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, join_hot, materialize


def components(edges: DataFrame, kind: str = "labels") -> DataFrame:
    """(node, component) for each node of `edges` (columns a, b); component is the least node reached.

    Every round takes the least label among the neighbours and then the label of that label. Nodes of many
    edges and components of many nodes are met by broadcast. Rounds write their labels to the shared folder and
    delete those of the round before; the loop ends with the first round that changes nothing.
    """
    both = materialize(edges.select("a", "b").where("a <> b").unionByName(edges.selectExpr("b as a", "a as b").where("a <> b")).distinct(), kind)
    degrees = both.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n"))
    labels = materialize(degrees.select(F.col("a").alias("node"), F.least("a", "low").alias("component"), "n"), kind)
    while True:
        near = join_hot(both, labels.withColumnRenamed("node", "b"), "b", "n").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("low"))
        lower = materialize(labels.join(near, "node").select("node", "n", F.col("component").alias("was"), F.least("component", "low").alias("component")), kind)
        sizes = lower.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        jump = materialize(lower.select(F.col("node").alias("component"), F.col("component").alias("further")).join(sizes, "component"), kind)
        moved = materialize(join_hot(lower, jump, "component", "size").select("node", "n", "was", F.least("component", "further").alias("component")), kind)
        drop(labels, lower, jump)
        labels = moved.select("node", "component", "n")
        if moved.where("was <> component").isEmpty():
            drop(both)
            return labels.drop("n")
