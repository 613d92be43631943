"""Connected components of an undirected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached. ``nodes`` has node, ``edges`` a and b, all long.

    Labels go to neighbours and then to the labels' own labels, which halves long chains, until none changes.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "edges")
    labels = stored(nodes.select("node", F.col("node").alias("component")), "labels")
    while True:
        heard = both.join(labels, both["a"] == labels["node"]).groupBy("b").agg(F.min("component").alias("least"))
        moved = labels.join(heard, labels["node"] == heard["b"], "left").select("node", "component", F.least("component", F.coalesce("least", "component")).alias("next"))
        jump = moved.select(F.col("node").alias("at"), F.col("next").alias("further"))
        moved = stored(moved.join(jump, moved["next"] == jump["at"], "left").select("node", "component", F.coalesce("further", "next").alias("next")), "labels")
        labels = moved.select("node", F.col("next").alias("component"))
        if moved.filter("component <> next").isEmpty():
            return labels
