"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest id it is connected to.

    Nodes that are their own root are left out, and so are edges from a node to
    itself and those with a null end; repeated edges, in either direction, are
    one. No edges give no rows. Large-star and small-star steps
    alternate until nothing changes; a node's edges are reduced by min(), never
    collected, so a hub with many neighbours is no problem.
    """
    stars = cut(_directed(edges))
    before = None
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(least, "a")
        small = joined.select("a", F.col("low").alias("b")).unionByName(joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")))
        stars = cut(small.where("a <> b").distinct())
        now = stars.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def _directed(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
