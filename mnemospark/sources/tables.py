"""Reading the store's tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of ``folder``: a Parquet file or a folder of them."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def latest_memories(memories: DataFrame) -> DataFrame:
    """One row per memory id: the newest snapshot.

    Repeated rows are exact copies or older snapshots with an earlier ``last_accessed`` and lower counters.
    Rows without an id are dropped. The newest row is found by ``max_by`` with a partial aggregate on the map side,
    so that a much repeated id costs no more than any other.
    """
    # Maps can't be compared, so they stay out of the ordering.
    order = F.struct("last_accessed", "recall_count", "startup_count", "reflect_count", "status", "summary")
    # One aggregate a column, so that those nobody asks for are pruned down to the scan.
    newest = [F.max_by(c, order).alias(c) for c in memories.columns if c != "id"]
    return memories.where(F.col("id").isNotNull()).groupBy("id").agg(*newest).select(*memories.columns)


def distinct_events(events: DataFrame, where: str = "true") -> DataFrame:
    """One row per event id; repeated rows are copies of each other, so ``where`` filters before they are folded."""
    return events.where(F.col("id").isNotNull()).where(where).dropDuplicates(["id"])
