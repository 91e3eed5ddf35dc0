"""Ranking features: one row for each query and candidate, missing ranks and scores null."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions.scores import days_between, decay_rate
from mnemospark.functions.text import theme_words, words

CATEGORIES = ("episodic", "semantic", "procedural", "reflection", "meta", "entity")


def _window(asked: list[str], text: list[str]) -> float:
    """Number of distinct query words over the length of the shortest stretch that has them all; 0 if one is missing."""
    wanted = set(asked)
    if not wanted:
        return 0.0
    count: dict[str, int] = {}
    best, left, have = None, 0, 0
    for right, word in enumerate(text):
        if word in wanted:
            count[word] = count.get(word, 0) + 1
            have += count[word] == 1
            while have == len(wanted):
                best = min(best or len(text) + 1, right - left + 1)
                first = text[left]
                if first in wanted:
                    count[first] -= 1
                    have -= count[first] == 0
                left += 1
    return len(wanted) / best if best else 0.0


def _proximity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [_window(a or [], t or []) for a, t in zip(batch.column("asked").to_pylist(), batch.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("memory_id"), pa.array(values, pa.float64())], ["query_id", "memory_id", "proximity"])


def proximity(candidates: DataFrame, queries: DataFrame, memories: DataFrame) -> DataFrame:
    """(query_id, memory_id, proximity): how close together a memory's content has all of a query's words."""
    asked = queries.select("query_id", F.array_distinct(words(F.col("query"))).alias("asked"))
    text = memories.select(F.col("id").alias("memory_id"), words(F.col("content")).alias("text"))
    rows = candidates.select("query_id", "memory_id").join(asked, "query_id").join(text, "memory_id").select("query_id", "memory_id", "asked", "text")
    kind = dict(candidates.dtypes)["query_id"]
    return rows.mapInArrow(_proximity, f"query_id {kind}, memory_id string, proximity double")


def ranking_features(fused: DataFrame, queries: DataFrame, memories: DataFrame, feedback: DataFrame, degrees: DataFrame, bursts: DataFrame, now: DataFrame) -> DataFrame:
    """Features of each candidate: its ranks in the channels, the match of words, feedback, and the memory's own traits.

    ``fused`` has query_id, memory_id, score and the ranks keyword_rank and theme_rank; ``now`` is one row. Ages are in
    days. A null stands for what a candidate doesn't have; counts of nothing are 0.
    """
    asked = queries.select("query_id", F.array_distinct(words(F.col("query"))).alias("asked"))
    own = memories.crossJoin(F.broadcast(now)).select(
        F.col("id").alias("memory_id"),
        F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category")).cast("int").alias("category"),
        F.col("base_priority").alias("priority"),
        days_between(F.col("now"), F.col("created_at")).alias("age_days"),
        F.coalesce("token_count", F.lit(0)).alias("token_count"),
        F.size(F.coalesce("themes", F.array())).alias("theme_count"),
        F.coalesce("confidence", F.lit(0.5)).alias("confidence"),
        decay_rate(F.col("decay_rate"), F.col("category")).alias("decay_rate"),
        F.array_distinct(words(F.col("content"))).alias("content_words"),
        theme_words(F.col("themes")).alias("theme_words"),
    )
    rows = fused.join(asked, "query_id").join(own, "memory_id").join(feedback, "memory_id", "left").join(degrees, "memory_id", "left").join(bursts.drop("events"), "memory_id", "left")
    pool = Window.partitionBy("query_id")
    found = rows.withColumn("query_length", F.size("asked")).withColumn("matched", F.size(F.array_intersect("asked", "content_words")))
    return found.select(
        "query_id", "memory_id", "score", "keyword_rank", "theme_rank",
        F.size(F.array_intersect("asked", "theme_words")).alias("theme_overlap"),
        F.abs(F.col("keyword_rank") - F.col("theme_rank")).alias("rank_gap"),
        F.cume_dist().over(pool.orderBy("score")).alias("score_percentile"),
        F.when(F.col("query_length") > 0, F.col("matched") / F.col("query_length")).otherwise(0.0).alias("query_coverage"),
        "query_length",
        F.count(F.lit(1)).over(pool).alias("pool_size"),
        "category", "priority", "age_days", "token_count", "theme_count", "confidence", "decay_rate",
        F.coalesce("fb_count", F.lit(0)).alias("fb_count"), "fb_mean", "fb_last", "fb_time_weighted",
        F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce("burstiness", F.lit(0.0)).alias("burstiness"),
    )
