"""Connected components of a link table, by alternating large-star and small-star steps.

Every step sends each node's neighbours to the smallest one; the link count never grows, and the number of
rounds grows with the logarithm of the longest path. Each round's links are written to the shared folder,
and the round before is removed, so a lost executor costs one round at most. Nothing is collected but two
numbers per round, which tell whether the links still change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialise_at


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a")).distinct()
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node with a link, the root being the smallest node of its component. links: (a, b) long."""
    spark = links.sparkSession
    seen, path = None, None
    current = links.filter("a <> b")
    while True:
        step, new = materialise_at(_small_star(_large_star(current)), name)
        state = step.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_000_007).alias("s")).first()
        if path:
            drop_table(spark, path)
        current, path = step, new
        if state == seen:
            return current.select(
                F.col("a").alias("node"), F.col("b").alias("root"),
            ).union(current.select(F.col("b"), F.col("b")).distinct())
        seen = state
