"""Connected components of an edge list, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.plans.storage import cut


def connected_components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """edges a, b -> node, component (the least node of its component). Each round is written to the
    shared folder, so the plan doesn't grow and a lost executor costs one round."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(most_rounds):
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        own = large.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(large.join(own, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own.select("u", "m")).filter("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
