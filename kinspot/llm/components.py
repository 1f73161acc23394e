"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinspot.llm.stage import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour instead."""
    both = links.select("high", "low").union(links.select(F.col("low"), F.col("high"))).toDF("node", "other")
    least = both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("least"))
    return both.filter("other > node").join(least, "node").select(F.col("other").alias("high"), F.col("least").alias("low"))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of these."""
    least = links.groupBy("high").agg(F.min("low").alias("least"))
    tied = links.join(least, "high")
    moved = tied.filter("low > least").select(F.col("low").alias("high"), F.col("least").alias("low"))
    return least.select("high", F.col("least").alias("low")).union(moved)


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) of every node of ``links`` (two integer columns).

    The number of rounds grows with the logarithm of the number of nodes; each
    round is a table in the shared folder. Links of a node to itself and
    nulls are left out. No links give no rows.
    """
    a, b = links.columns
    now = links.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).dropna().filter("high > low").distinct()
    while True:
        now = stored(_small_star(_large_star(now)).distinct(), "stars")
        # done when every node has one centre, and no centre has one of its own
        several = now.groupBy("high").agg(F.count("*").alias("n")).filter("n > 1").select("high")
        deep = now.join(now.select(F.col("low").alias("high")), "high", "left_semi").select("high")
        if several.union(deep).isEmpty():
            break
    roots = now.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    return now.select(F.col("high").alias("node"), F.col("low").alias("component")).union(roots)
