"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import saved, with_unique


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node of its component) for every node of an edge between two different nodes.

    Alternating stars: each node hands its larger, then its smaller neighbours to the smallest node it knows, until
    every edge points at a root. The rounds grow with the logarithm of the component's size; each is a written table.
    A hub's edges are never gathered: its minimum is a partial aggregate, which meets the edges in a broadcast or salted join.
    """
    pairs = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    pairs, before = saved(pairs, "edges"), None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = with_unique(both, saved(least, "least"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large, "large-star")
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = with_unique(large, least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = saved(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
