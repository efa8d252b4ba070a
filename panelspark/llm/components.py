"""Connected components by alternating large-star and small-star contraction, with lineage cut each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, keep


def _towards(pairs: DataFrame) -> DataFrame:
    """(u, v) with v's of each u, and the least of them: an aggregate with map-side combining, joined back, so that a hub is never one task's group."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest reachable node) for every node of edges (a, b); loops and repeats are harmless.

    Nulls on either end link nothing. No edges give an empty table.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    before, old = None, None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        small = _towards(large)
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        e = keep(small)
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        if old is not None:
            forget(old)
        if now == before:
            break
        before, old = now, e
    label = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return label.unionByName(label.select(F.col("component").alias("node"), "component").distinct())
