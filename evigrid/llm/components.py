"""Connected components of links, by alternating large-star and small-star rounds over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _least(edges: DataFrame) -> DataFrame:
    """Every (u, v) with m, the least of u and all its neighbours. Minima are pre-aggregated and staged, so that the join
    has plain scans on both sides: Spark broadcasts a small one, and splits a hot u of a large one."""
    least = common.staged(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "links-least")
    return edges.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """links: u, v (long). Returns node, component: the least node reachable, for every node with a link."""
    edges = common.staged(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        met = _least(common.staged(large, "links-large"))
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(met.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = common.staged(small, "links")
        now = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
        if before == now:
            break
        before = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()).groupBy("node").agg(F.min("component").alias("component"))
