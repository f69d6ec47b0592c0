"""Connected components of an edge table by alternating stars, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.blocks import checkpoint_dir


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def components(edges: DataFrame) -> DataFrame:
    """`a`, `b` links; returns `id`, `root`, the least id of its component, for ids other than roots.

    Each round points every id's larger neighbours, then its smaller ones, at the least
    neighbour; the number of rounds grows with the logarithm of the longest chain. Hubs are
    aggregated before the shuffle, and Spark splits them in the joins.
    """
    checkpoint_dir(edges.sparkSession)
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        before, state = state, _state(now)
        if state == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
