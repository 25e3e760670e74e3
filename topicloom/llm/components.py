"""Connected components of an edge table, as joins over staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): label is the smallest node of its component.

    Each round takes the smallest label among a node and its neighbours and
    then the label of that label, until nothing changes. Joins run between
    written tables, whose skewed partitions Spark can split, so a node with a
    large share of all edges is not one task.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        around = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("_near"))
        near = stage(labels.join(around, labels["node"] == around["a"]).select("node", F.least("label", "_near").alias("label"), F.col("label").alias("_old")))
        jump = near.select(F.col("node").alias("_at"), F.col("label").alias("_next"))
        new = stage(near.join(jump, near["label"] == jump["_at"], "left").select("node", F.least("label", F.coalesce("_next", "label")).alias("label"), "_old"))
        if new.filter("label <> _old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
