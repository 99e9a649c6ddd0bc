"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import discard, spread, stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours move to its smallest neighbour."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(spread(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(links: DataFrame) -> DataFrame:
    """Every node's smaller neighbours, and itself, move to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(spread(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _is_forest(links: DataFrame) -> bool:
    """Whether every larger node has one link, and no smaller node is the larger one of another link."""
    if not links.groupBy("u").count().filter("count > 1").isEmpty():
        return False
    return links.select("v").distinct().join(links.select("u"), F.col("v") == F.col("u"), "left_semi").isEmpty()


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node.

    ``links`` has two long columns, u and v.  Each round is written to the shared
    folder; the rounds end when every node points at one root.  Joins are on one
    node, and a node with very many links is split by adaptive skew joins.
    """
    now = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), label)
    while not _is_forest(now):
        new = stored(_small_star(_large_star(now)), label)
        discard(now)
        now = new
    # the roots point at themselves
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
