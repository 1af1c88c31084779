"""Connected components of an edge table, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import cut, scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a, b); root is the smallest node of its component.

    Each round points every node at its smallest neighbour, or at itself, and replaces the edges' ends by what they point
    at; a star is done in one round, a chain in about the logarithm of its length. The rounds' tables are then joined from
    the last to the first. A hub's many edges meet its one row in joins between written tables, which Spark can split."""
    with scratch():
        rounds = []
        e = cut(edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        while not e.isEmpty():
            both = e.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(e.select(F.col("b").alias("node"), F.col("a").alias("other")))
            points = cut(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("root")), "points")
            rounds.append(points)
            at_a, at_b = (points.select(F.col("node").alias(x), F.col("root").alias(f"to_{x}")) for x in "ab")
            left = e.join(at_a, "a").join(at_b, "b").where(F.col("to_a") != F.col("to_b"))
            e = cut(left.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        out = rounds.pop() if rounds else e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        while rounds:
            later = out.select(F.col("node").alias("root"), F.col("root").alias("last"))
            out = rounds.pop().join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
        return cut(out, "roots", result=True)
