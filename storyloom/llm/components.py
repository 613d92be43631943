"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b): equal labels for connected nodes, the label being one of them.

    In each round every node points to the smallest of itself and its neighbours, edges move to what
    their ends point to, and loops go; it ends when no edge is left. Ids are hashes, so that chains of
    descending ids are short and rounds few. A node with many edges is pre-aggregated where its edges
    lie. Self loops and null ends are ignored.
    """
    edges = edges.select("a", "b").filter("a <> b")
    edges = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = edges.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    while not edges.isEmpty():
        to = written(edges.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")), "pointers")
        # Two steps at once: where a node points to, points further.
        next_ = to.select(F.col("a").alias("to"), F.col("to").alias("further"))
        to = written(to.join(next_, "to", "left").select("a", F.coalesce("further", "to").alias("to")), "pointers")
        labels = written(labels.join(to, labels["label"] == to["a"], "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        ends = to.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        moved = edges.join(to, "a").select("b", F.col("to").alias("to_a")).join(ends, "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
        edges = written(moved.filter("a <> b").distinct(), "edges")
    return labels
