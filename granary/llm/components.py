"""Connected components by alternating large and small stars; every step is a join and an aggregate.

A node may have any number of neighbours: the least one is found by an aggregate that combines before
it shuffles, and written, so that the join with it has an exchange on each side and a node that fills
a partition is split by adaptive execution instead of meeting in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import discard, written


def large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new edges, and a table to delete when they are written."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), least


def small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges point from the larger node to the smaller."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")))
    to_least = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return to_least.unionAll(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), least


def components(edges: DataFrame) -> DataFrame:
    """From pairs of nodes (u, v) of any type with an order: node, and the smallest node of its component as ``root``.

    Only nodes with an edge to another node are returned. Each step's edges are written to the shared
    folder, so a lost executor repeats one step at most; tables of earlier steps are deleted.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == mark or not seen.n:
            break
        mark = seen
        for star in (large_star, small_star):
            new, least = star(now)
            done = written(new)
            discard(now, least)
            now = done
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
