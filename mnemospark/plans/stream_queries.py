"""Queries that run as streams over the event log, to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.plans import parts as P
from mnemospark.plans.feedback_queries import SUMMARY
from mnemospark.sources.tables import table
from mnemospark.streaming import events as S


def stream_daily_counts(spark: SparkSession, folder: str) -> DataFrame:
    return S.drain(S.daily_counts(S.timed(S.event_stream(spark, folder))), "update", ["day", "event_type"], "events")


def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Per session the number of its bursts and the size of the longest: those that the watermark has closed, and those still open at the end."""
    closed, watermark = S.drain_to_watermark(S.bursts(S.timed(S.event_stream(spark, folder).where("session_id is not null"))))
    still = S.open_bursts(S.timed(table(spark, folder, "memory_events").where("session_id is not null")), watermark)
    return closed.unionByName(still).groupBy("session_id").agg(F.count(F.lit(1)).alias("bursts"), F.max("events").alias("longest"))


def retrieval_sliding(spark: SparkSession, folder: str) -> DataFrame:
    """Memories and retrievals in windows of thirty days that move by ten."""
    found = S.sliding_retrievals(S.timed(table(spark, folder, "memory_events")))
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("start"), "memories", "events")


def stream_matches(spark: SparkSession, folder: str) -> DataFrame:
    left, right = S.timed(S.event_stream(spark, folder)), S.timed(S.event_stream(spark, folder))
    return S.drain(S.matches(left, right)).select("feedback_id", "recall_id", F.round("gap", 6).alias("gap"))


def stream_smoothed_utility(spark: SparkSession, folder: str) -> DataFrame:
    found = S.drain(S.smoothed_utility(S.timed(S.event_stream(spark, folder), "3650 days")), "update", ["memory_id"], "count")
    return found.select("memory_id", F.round("ewma", 6).alias("ewma"), "count")


QUERIES = {f.__name__: f for f in (retrieval_sliding, stream_daily_counts, stream_sessions, stream_matches, stream_smoothed_utility)}

SQL = {
    "stream_daily_counts": P.ctes(P.EVT) + "SELECT strftime(created_at, '%Y-%m-%d') AS day, event_type, count(*) AS events FROM evt WHERE created_at IS NOT NULL GROUP BY ALL",
    "retrieval_sliding": P.ctes(P.EVT) + """SELECT strftime(make_timestamp((floor(epoch_us(created_at) / 864000000000)::BIGINT - k) * 864000000000), '%Y-%m-%d') AS start, count(DISTINCT memory_id) AS memories, count(*) AS events
      FROM evt, (SELECT unnest([0, 1, 2]) AS k) WHERE event_type = 'retrieved' AND created_at IS NOT NULL GROUP BY 1""",
    "stream_sessions": P.ctes(P.EVT, """g AS (SELECT session_id, epoch_us(created_at) - lag(epoch_us(created_at)) OVER (PARTITION BY session_id ORDER BY created_at) AS gap, created_at FROM evt WHERE session_id IS NOT NULL AND created_at IS NOT NULL),
      b AS (SELECT session_id, sum(CASE WHEN gap IS NULL OR gap >= 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY created_at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS burst FROM g),
      c AS (SELECT session_id, burst, count(*) AS n FROM b GROUP BY ALL)""") + "SELECT session_id, count(*) AS bursts, max(n) AS longest FROM c GROUP BY session_id",
    "stream_matches": P.ctes(P.EVT) + """SELECT f.id AS feedback_id, r.id AS recall_id, round((epoch_us(f.created_at) - epoch_us(r.created_at)) / 1e6, 6) AS gap FROM evt f JOIN evt r ON f.session_id = r.session_id
      AND epoch_us(f.created_at) - epoch_us(r.created_at) BETWEEN 0 AND 60000000 WHERE f.event_type = 'feedback' AND r.event_type = 'recall_meta'""",
    "stream_smoothed_utility": P.ctes(P.FB.replace("AND id IS NOT NULL", "AND id IS NOT NULL AND created_at IS NOT NULL"), P.NOW, SUMMARY) + "SELECT memory_id, round(fb_ewma, 6) AS ewma, fb_count AS count FROM sm",
}
