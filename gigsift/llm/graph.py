"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node around it."""
    around = links.select(F.col("low").alias("u"), F.col("high").alias("v")).union(links.select("high", "low"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (links.select(F.col("low").alias("u"), F.col("high").alias("v")).join(least, "u").filter("v > m")
            .select(F.col("v").alias("high"), F.col("m").alias("low")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of these."""
    least = links.groupBy("high").agg(F.min("low").alias("m"))
    moved = links.join(least, "high").filter("low > m").select(F.col("low").alias("high"), F.col("m").alias("low"))
    return moved.union(least.select("high", F.col("m").alias("low"))).distinct()


def _is_settled(links: DataFrame) -> bool:
    roles = links.select(F.col("high").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        links.select("low", F.lit(0), F.lit(1)))
    ends = roles.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (low, high), low < high: the smallest node it is connected with.

    Alternating large-star and small-star contraction (Kiveris et al., 2014): each round is two aggregations and two joins over
    the remaining links, written to the shared folder. A hub's rows meet in sort-merge joins only, which adaptive execution splits.
    """
    links = stored(links.distinct(), "links")
    while not _is_settled(links):
        links = stored(_small_star(stored(_large_star(links), "links")), "links")
    roots = links.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct()
    return links.select(F.col("high").alias("node"), F.col("low").alias("root")).union(roots)
