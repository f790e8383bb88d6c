"""Connected components of an edge table, also with edges that come later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.plans.components import components
from tallyframe.plans.session import written


def joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """The components (node, root) after further edges (a, b) between nodes, old or new."""
    ra, rb = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in ("a", "b"))
    between = edges.join(ra, "a", "left").join(rb, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    more = written(components(between))
    moved = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return moved.unionByName(more.join(roots.select("node"), "node", "left_anti"))
