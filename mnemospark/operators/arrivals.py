"""Arriving memories held against the store: which are new, which repeat or replace an older one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.config import MAINTENANCE, Maintenance
from mnemospark.operators.nearest import nearest_before


def arrival_outcomes(store: DataFrame, vectors: DataFrame, params: Maintenance = MAINTENANCE) -> DataFrame:
    """(id, outcome, other, distance) for each memory of the store (id, category, base_priority, created_at) as it arrived.

    It is held against the memories of its category that came before it, wherever they stand among its nearest today. If the nearest
    is closer than the threshold, the one of higher priority stays: the arrival supersedes it, or is rejected as a repeat. All others
    are inserted, with the nearest one if there is any. Arrivals of one moment don't see each other. Arrivals without
    a usable vector (memory_id, embedding), a category or a time are inserted.
    """
    rows = store.select("id", F.col("category").alias("kind"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("place"))
    near = nearest_before(rows.join(vectors.select(F.col("memory_id").alias("id"), F.col("embedding").alias("vector")), "id"))
    traits = store.select(F.col("id").alias("other"), F.col("base_priority").alias("other_priority"))
    nearest = near.select("id", "other", F.round(1 - F.col("cosine"), 9).alias("distance")).join(traits, "other")
    close = F.col("distance") < params.dedup_distance
    outcome = F.when(close & (F.col("base_priority") > F.col("other_priority")), "superseded").when(close, "dedup_rejected").otherwise("inserted")
    return store.select("id", "base_priority").join(nearest, "id", "left").select("id", outcome.alias("outcome"), "other", "distance")
