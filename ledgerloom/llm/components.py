"""Connected components by alternating large-star and small-star steps, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for each vertex of edges (u long, v long) that is not its component's smallest.

    Each round halves the distance to the smallest vertex; a round's result is written, so a lost
    executor never costs more than one round.
    """
    e = cut(edges.where("u <> v").selectExpr("greatest(u, v) u", "least(u, v) v").distinct())
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return e.select("u", F.col("v").alias("root"))
        before = state
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        e = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
