"""Connected components as joins and grouped minima, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of the edges (a, b); component is the least node.

    Alternates large-star and small-star steps until every node points at its minimum.
    A step is one grouped minimum and one join on the node; Spark splits a skewed join, and
    minima are pre-aggregated, so a hub with a third of all edges is no single task. Each
    round is written to the shared folder, so a lost executor re-reads one round at most.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), "m", "u")
        small = small.select(F.explode(F.array(F.struct("x", "m"), F.struct(F.col("u").alias("x"), "m"))).alias("e"))
        small = small.select(F.col("e.x").alias("u"), F.col("e.m").alias("v")).where("u <> v").distinct()
        after = stored(small)
        # done when every node has one parent and no parent has a parent
        roots = after.select(F.col("v").alias("u")).distinct()
        many = after.groupBy("u").count().where("count > 1")
        if after.join(roots, "u", "left_semi").isEmpty() and many.isEmpty():
            break
        now = after
    roots = after.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return after.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
