"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.storage import dropped, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (longs). Returns (node, component), component the smallest node reachable; nodes
    without an edge to another node are not listed. Each round is stored in the shared folder.

    The smallest neighbours are stored before the edges meet them, so that the join reads plain
    shuffles and Spark can split the edges of a node with very many.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "low")
        larger = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(larger.distinct(), "large")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        smaller = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, stored(smaller.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        dropped(last, low, large)
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = mark
