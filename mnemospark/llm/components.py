"""Pairwise matches consolidated into groups: connected components by alternating star operations.

Large-star links every larger neighbour of a node to the smallest of its neighbourhood; small-star does so for the
smaller neighbours and the node itself. Repeated in turn, they turn each component into a star around its smallest
id, in a number of rounds that grows with the logarithm of the component's diameter. Both are a grouped minimum
(partial aggregates on the map side, so a hub costs one row per task) and one join back, whose large partitions
adaptive execution splits. No neighbour list is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.runtime import checkpoint

MAX_ROUNDS = 100


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    hashed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(hashed), F.sum(F.shiftright(hashed, 20))).first())


def connected_components(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """(member, component) for every id in a group of two or more; component is the group's smallest id.

    Null ends and pairs of an id with itself link nothing; repeated and reversed pairs count once. An empty table gives
    an empty result.
    """
    edges = checkpoint(
        pairs.select(F.col(left).alias("x"), F.col(right).alias("y"))
        .where("x is not null and y is not null and x <> y")
        .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        .distinct()
    )
    before = None
    for _ in range(MAX_ROUNDS):
        edges = checkpoint(_small_star(_large_star(edges)))
        now = _mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"the stars didn't settle within {MAX_ROUNDS} rounds")
    centres = edges.select(F.col("b").alias("member")).distinct().select("member", F.col("member").alias("component"))
    return edges.select(F.col("a").alias("member"), F.col("b").alias("component")).unionByName(centres)
