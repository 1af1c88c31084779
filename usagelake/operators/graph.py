"""Graphs of scopes as edge tables: connected groups and descendants.

Both run until nothing changes, so cycles end. Every round's result is written to the shared checkpoint folder; the driver
only learns whether there was a change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import kept


def component_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that edges (child, parent) lead to in either direction. nodes: (node)."""
    both = edges.select(F.col("child").alias("a"), F.col("parent").alias("b")).unionByName(edges.select(F.col("parent").alias("a"), F.col("child").alias("b"))).where("a <> b").distinct()
    both = kept(both)
    known = nodes.select("node").union(both.select("a")).distinct()
    labels = kept(known.select("node", F.col("node").alias("component")))
    while True:
        offered = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("offer"))
        nearer = labels.join(offered, labels["node"] == offered["a"], "left").select("node", F.least("component", "offer").alias("near"), "component")
        # The label of the label, too: chains halve instead of losing one link a round.
        far = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        after = kept(nearer.join(far, "near", "left").select("node", F.least("near", "far").alias("component"), F.col("component").alias("before")))
        labels = after.select("node", "component")
        if after.where("component <> before").isEmpty():
            return labels


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node): the roots (node) and all that reach one through edges from child to parent."""
    seen = kept(roots.select("node").distinct())
    front = seen
    while True:
        front = kept(edges.join(front, edges["parent"] == front["node"], "left_semi").select(F.col("child").alias("node")).distinct().join(seen, "node", "left_anti"))
        if front.isEmpty():
            return seen
        seen = kept(seen.unionByName(front))
