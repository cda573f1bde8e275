"""Connected components of a large graph in Spark.

The alternating star algorithm of Kiveris et al. (SoCC 2014): links are replaced by links to the smallest
neighbour until every component is a star around its smallest node. A round is two aggregations and two
joins over the links; no neighbourhood is gathered in a task, and a centre that many nodes point to is a
skewed join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.staging import stage


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest among the node and its neighbours."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    moved = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.filter("u != v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest of them. Links point to the smaller node."""
    least = links.groupBy("u").agg(F.min("v").alias("least"))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(least.select("u", F.col("least").alias("v"))).filter("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (u, v), where component is the smallest node reachable.

    Nodes without links are not listed; links of a node with itself, repeated links and null ends are ignored.
    """
    clean = links.filter("u is not null and v is not null and u != v")
    stars = stage(clean.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        # A star forest is left as it is by both steps, so equal sums of all links mean that it is reached.
        now = tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38, 0)"))).first())
        if now == seen or not now[0]:
            break
        seen = now
        stars = stage(_small_star(_large_star(stars)), "links")
    leaves = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
