"""Connected components by alternating large and small stars, each step joins and aggregates of narrow rows.

Every step points edges at the smallest node known so far, so the edges become one star per component. No list of
neighbours is ever built: a step aggregates the smallest neighbour of each node and joins it back, and a hot node is split
as a skewed join. Steps are cut by written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.session import stage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of the edges (a, b); self loops and repeats don't matter."""
    stars = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state, before = _state(stars), None
    while state != before:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        before, state = state, _state(stars)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
