"""Connected components by alternating large stars and small stars (Kiveris et al. 2014).

Edges between nodes that already share a component are few in every round, hubs are
aggregated on the map side, and each round ends in a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.llm.common import prepare

MAX_ROUNDS = 60


def _state(stars: DataFrame) -> tuple:
    row = stars.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h"), F.bit_xor(F.xxhash64("b", "a")).alias("g")).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b), long -> node, root: the least node reachable; nodes without edges are not in it."""
    prepare(edges.sparkSession)
    stars = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().checkpoint()
    before = _state(stars)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        nearest = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(nearest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = moved.union(nearest.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        after = _state(stars)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
