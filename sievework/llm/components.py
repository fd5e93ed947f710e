"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """links: (a, b), any order, without loops. Gives (node, component) for every node with a link; component is the smallest node that it reaches.

    Each round replaces links by stars towards the smallest neighbour; only sums over neighbours and equi-joins are used, so a hub costs one partial sum a task, and its joins are sort-merge joins whose large side Spark may split. Each round is a written table. Rounds grow with the logarithm of the longest path. An empty table gives an empty one."""
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    before, at = None, 0
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = scratch.save(small.union(least).distinct(), f"{name}-{at}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            scratch.drop(f"{name}-{at - 1}")
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        if at:
            scratch.drop(f"{name}-{at - 1}")
        before, at = now, at + 1
