"""Inputs that several queries share, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators.feedback import utilities
from mnemospark.operators.maintenance import latest_time
from mnemospark.sources.tables import distinct_events, latest_memories, table


def r6(column: Column | str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6)


def memories(spark: SparkSession, folder: str) -> DataFrame:
    return latest_memories(table(spark, folder, "memories"))


def active(spark: SparkSession, folder: str) -> DataFrame:
    return memories(spark, folder).where("status = 'active'")


def events(spark: SparkSession, folder: str, where: str = "true") -> DataFrame:
    return distinct_events(table(spark, folder, "memory_events"), where)


def now(spark: SparkSession, folder: str) -> DataFrame:
    return latest_time(table(spark, folder, "memory_events"))


def feedback(spark: SparkSession, folder: str) -> DataFrame:
    return utilities(table(spark, folder, "memory_events"))


def recalls(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "memory_events").where("event_type = 'recall_meta' and id is not null")
    return rows.select("id", "query", "session_id", "created_at").dropDuplicates(["id"])


def search_queries(spark: SparkSession, folder: str) -> DataFrame:
    """The stated query set of searches: recalls whose id is divisible by 100, against all memories."""
    return recalls(spark, folder).where("id % 100 = 0 and query is not null").select(F.col("id").alias("query_id"), "query")


MEM = """mem AS (SELECT * FROM memories WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY
  last_accessed DESC NULLS LAST, recall_count DESC NULLS LAST, startup_count DESC NULLS LAST, reflect_count DESC NULLS LAST, status DESC NULLS LAST, summary DESC NULLS LAST) = 1),
act AS (SELECT * FROM mem WHERE status = 'active')"""
EVT = "evt AS (SELECT * FROM memory_events WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at) = 1)"
NOW = "clock AS (SELECT max(created_at) AS now FROM memory_events)"
FB = """fb AS (SELECT id, any_value(memory_id) AS memory_id, any_value(session_id) AS session_id, any_value(created_at) AS created_at,
  any_value(greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(TRY_CAST(json_extract_string(context, '$.utility') AS DOUBLE), 0.0::DOUBLE)))) AS utility
  FROM memory_events WHERE event_type = 'feedback' AND memory_id IS NOT NULL AND id IS NOT NULL GROUP BY id)"""
REC = "rec AS (SELECT id, any_value(query) AS query, any_value(session_id) AS session_id, any_value(created_at) AS created_at FROM memory_events WHERE event_type = 'recall_meta' AND id IS NOT NULL GROUP BY id)"
QRY = "qry AS (SELECT id AS query_id, query FROM rec WHERE id % 100 = 0 AND query IS NOT NULL)"
DAYS = "(epoch_us({}) - epoch_us({})) / 86400e6"
PRIORITY = """CASE WHEN list_has_any(flags, ['pinned', 'keep']) IS TRUE OR rate = 0 OR last_accessed IS NULL THEN base_priority::DOUBLE
  ELSE greatest(base_priority::DOUBLE * exp(-rate * greatest(0.0::DOUBLE, (epoch_us(now) - epoch_us(last_accessed)) / 86400e6)), base_priority::DOUBLE * 0.35) END"""
RATED = """rated AS (SELECT *, coalesce(decay_rate, CASE category WHEN 'entity' THEN 0.0 WHEN 'meta' THEN 0.004 WHEN 'reflection' THEN 0.006
  WHEN 'semantic' THEN 0.008 WHEN 'procedural' THEN 0.012 WHEN 'episodic' THEN 0.023 END, 0.008)::DOUBLE AS rate FROM mem, clock)"""
THEMES = "list_filter(coalesce(themes, []::VARCHAR[]), lambda t: t IS NOT NULL AND trim(t, ' ') <> '')"


def distinct_list(expression: str) -> str:
    """A list with each entry once, in the order of first use."""
    return f"list_transform(list_filter(list_zip({expression}, range(1, len({expression}) + 1)), lambda p: list_position({expression}, p[1]) = p[2]), lambda p: p[1])"


NORMAL = distinct_list(f"list_transform({THEMES}, lambda t: replace(replace(t, '_', '-'), ' ', '-'))")
WORDS = r"coalesce(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'), []::VARCHAR[])"


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
