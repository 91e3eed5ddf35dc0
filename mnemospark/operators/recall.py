"""Recall with all three channels, filters on what was ranked, and memories related to a stored one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.config import SCORING, Scoring
from mnemospark.operators.expansion import by_centroid
from mnemospark.operators.retrieval import fuse, keyword_channel, top_k, vector_channel
from mnemospark.operators.search import with_vectors


def since_time(text: Column, now: Column) -> Column:
    """The time that ``Nd`` (N days before now) or an ISO date or time stands for; null where it is neither."""
    days = F.regexp_extract(F.trim(text), r"^(\d+)d$", 1)
    return F.when(days != "", now.cast("timestamp") - F.make_dt_interval(days.try_cast("int"))).otherwise(F.trim(text).try_cast("timestamp"))


def query_vectors(keywords: DataFrame, vectors: DataFrame, seeds: int = 5) -> DataFrame:
    """(query_id, vector): the mean vector of each query's first keyword hits, for queries that bring none of their own.

    ``vectors`` is (memory_id, embedding). Queries without a hit that has a vector get none.
    """
    return by_centroid(keywords.where(F.col("rank") < seeds).select("query_id", "memory_id"), vectors)


def three_channels(keywords: DataFrame, themes: DataFrame, near: DataFrame, params: Scoring = SCORING) -> DataFrame:
    """Fused scores of keyword, theme and vector ranks; ``near`` is (query_id, memory_id, rank)."""
    return fuse({
        "keyword": (keywords, params.keyword_k, params.keyword_weight),
        "theme": (themes, params.theme_k, params.theme_weight),
        "vector": (near, params.vector_k, params.vector_weight),
    })


def filtered(scored: DataFrame, memories: DataFrame, keep: Column, limit: int = 10, fetched: int = 3) -> DataFrame:
    """The first ``limit`` of each query that pass ``keep``, among the first ``fetched`` times as many: filters come after ranking.

    ``memories`` has memory_id and the columns that ``keep`` asks for. A condition that is null fails.
    """
    first = top_k(scored, "query_id", [F.desc("score"), F.col("memory_id")], limit * fetched, "at").drop("at")
    passed = first.join(memories, "memory_id").where(keep)
    return top_k(passed.select("query_id", "memory_id", "score"), "query_id", [F.desc("score"), F.col("memory_id")], limit)


def related(asked: DataFrame, memories: DataFrame, vectors: DataFrame, limit: int = 5, params: Scoring = SCORING, own: DataFrame | None = None) -> DataFrame:
    """(memory_id, related_id, score, rank): for each memory of ``asked`` (memory_id, content) the nearest by vector and words, fused.

    Three times ``limit`` by the stored vector and by the first 200 characters of the content; the memory itself is none of
    them. ``memories`` are those to search, ``vectors`` (memory_id, embedding) has theirs, others' don't count; ``own``, if given, are those among
    them that may be asked for, so that not all are shuffled for these, and those packed. Of a memory's copies a usable one is asked with. A memory without
    a vector or words is searched by the other alone.
    """
    wide = 3 * limit
    own = with_vectors(asked.select("memory_id"), vectors if own is None else own).withColumnRenamed("memory_id", "query_id")
    near = vector_channel(own, vectors.select(F.col("memory_id").alias("id"), F.col("embedding").alias("vector")), k=wide + 1, among=memories.select("id"))
    words = keyword_channel(asked.select(F.col("memory_id").alias("query_id"), F.substring("content", 1, 200).alias("query")), memories, k=wide + 1, params=params)

    def others(df: DataFrame, order: list[Column]) -> DataFrame:
        return top_k(df.where("query_id <> memory_id").drop("rank"), "query_id", order, wide)

    by_vector = others(near.withColumnRenamed("id", "memory_id"), [F.col("distance"), F.col("memory_id")])
    by_words = others(words, [F.desc("bm25"), F.col("memory_id")])
    fused = fuse({"vector": (by_vector, params.related_k, params.vector_weight), "keyword": (by_words, params.related_k, 1 - params.vector_weight)})
    best = top_k(fused.withColumn("score", F.round("score", 9)), "query_id", [F.desc("score"), F.col("memory_id")], limit)
    return best.select(F.col("query_id").alias("memory_id"), F.col("memory_id").alias("related_id"), "score", "rank")


def channel_features(fused: DataFrame, keywords: DataFrame, themes: DataFrame, near: DataFrame) -> DataFrame:
    """(query_id, memory_id, score, ranks, distance, scores as shares of the query's best, number of channels) of the pool."""
    pool = Window.partitionBy("query_id")
    share = lambda c: F.when(F.max(c).over(pool) > 0, F.col(c) / F.max(c).over(pool))
    rows = (
        fused.join(keywords.select("query_id", "memory_id", "bm25"), ["query_id", "memory_id"], "left")
        .join(themes.select("query_id", "memory_id", "overlap"), ["query_id", "memory_id"], "left")
        .join(near.select("query_id", "memory_id", "distance"), ["query_id", "memory_id"], "left")
    )
    listed = sum((F.col(f"{c}_rank").isNotNull().cast("int") for c in ("keyword", "theme", "vector")), F.lit(0))
    return rows.select(
        "query_id", "memory_id", "score", "keyword_rank", "theme_rank", "vector_rank", F.col("distance").alias("vector_distance"),
        share("bm25").alias("keyword_share"), share("overlap").alias("theme_share"), (1 - F.col("distance")).alias("vector_share"), share("score").alias("score_share"), listed.alias("channels"),
    )


def pool_density(pool: DataFrame, memories: DataFrame, reach: int = 2) -> DataFrame:
    """(query_id, memory_id, neighbours): candidates of the same query that stand within ``reach`` places in the memory's session.

    Places are numbers in order of time, then id. Memories without a session have none beside them.
    """
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("created_at", "id"))
    placed = memories.where("session_id is not null").select(F.col("id").alias("memory_id"), "session_id", place.alias("place"))
    rows = pool.select("query_id", "memory_id").join(placed, "memory_id", "left")
    beside = F.count(F.lit(1)).over(Window.partitionBy("query_id", "session_id").orderBy("place").rangeBetween(-reach, reach)) - 1
    return rows.withColumn("neighbours", F.when(F.col("session_id").isNotNull(), beside).otherwise(F.lit(0))).select("query_id", "memory_id", "neighbours")
