"""Connected components of an edge table by hooking and shortcutting, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node that each node of edges reaches. Those smallest nodes themselves, and nodes without edges, aren't listed.

    Alternates large-star and small-star steps until the edges stop changing: each step links nodes to the smallest of their neighbours,
    so the rounds grow with the logarithm of the nodes. A step aggregates neighbours to their minimum (with map-side
    combining) and joins it back, so no node's neighbours are ever gathered.
    """
    links = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        # large-star: every larger neighbour of a node goes to the smallest of its neighbours or itself
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: a node's smaller neighbours, and itself, go to the smallest of them
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        spread = large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, links = links, written(spread.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "links")
        drop_written(old)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
