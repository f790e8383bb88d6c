"""Connected components of an edge table, by alternating star steps on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.plans.session import written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node that is reachable.

    Every round hangs each node's larger neighbours, then its smaller ones, under the smallest
    neighbour, which halves the depth of chains; it ends when every node hangs directly under one
    root. Each round is written to the shared folder, so a lost executor costs one round. A hot node's
    neighbours are never gathered: stars are a minimum per node and a join, which adaptive execution
    splits.
    """
    now = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        if now.join(now.select(F.col("b").alias("a")), "a", "left_semi").isEmpty() and now.groupBy("b").count().where("count > 1").isEmpty():
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select("a", "a").distinct())
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("m").alias("a"), "b").union(low.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")))
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(least.select(F.col("m").alias("a"), "b"))
        now = written(small.distinct())
    raise RuntimeError("components did not settle")
