"""Connected components by alternating large-star and small-star steps (Kiveris et al., SoCC 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.store import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(u, v): root is the smallest node reachable; nodes without edges have no row.

    Each step is two aggregations by key with map-side combination and a join. What is aggregated is written before it is joined:
    both sides then come from exchanges of their own, and adaptive execution can split the one in which a node has very many
    neighbours. Edges shrink to a star for each component in O(log^2 n) rounds. Each round is written to the shared
    folder; nothing is collected but two numbers a round.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, "large")
        drop(low)
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        for done in (low, large, now):
            drop(done)
        now = after
