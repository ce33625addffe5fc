"""Connected components by alternating large-star and small-star rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlode.llm._common import cut


def _signature(edges: DataFrame) -> tuple[int, int]:
    # xxhash64 modulo a prime keeps the sum of any number of rows within a decimal
    row = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(2147483647)))).first()
    return row[0], row[1] or 0


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Return (node, root): root is the least node reachable over ``edges``; roots themselves are left out.

    Both ends are longs. Null ends and loops are ignored, repeated edges count
    once. Edges never leave the executors; each round is written to the shared
    folder, and the rounds end when every component is a star (about the
    logarithm of the longest path). A hub's edges meet their minimum in a join,
    which Spark can split, not in a group.
    """
    stars = cut(edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b")).filter("a != b").distinct(), "edges")
    seen = _signature(stars)
    while seen[0]:
        both = stars.union(stars.select("b", "a")).toDF("x", "y")
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = cut(both.filter("y > x").join(least, "x").select(F.col("y").alias("a"), F.col("m").alias("b")).distinct(), "large")
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = cut(small.union(lower.select("a", F.col("m").alias("b"))).distinct(), "stars")
        now = _signature(stars)
        if now == seen:
            break
        seen = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
