"""Connected components of an edge table, as rounds of joins.

Large-star / small-star contraction: every round re-hangs neighbours on the
smallest neighbour of a node.  A node's smallest neighbour is a partial
aggregate, and the re-hanging is a join that Spark splits if a node is hot;
no neighbourhood is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One star round on edges (u, v) with u > v."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if larger else edges
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    if larger:
        moved = (both.filter("v > u").join(least, "u")
                     .select(F.col("v").alias("u"), F.col("m").alias("v")))
        return moved.filter("u <> v").distinct()
    moved = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) for every node of an edge, label the smallest node that
    can be reached.  An empty edge table gives no rows."""
    current = staged(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                          .filter("u > v").distinct(), "edges")
    mark = None
    while True:
        seen = tuple(current.agg(F.count("*"), F.sum(F.hash("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first())
        if seen == mark or not seen[0]:
            break
        mark = seen
        current = staged(_star(_star(current, True), False), "edges")
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return roots.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
