"""What has to hold at any size: pruned scans, pushed filters, hot groups without lists."""

from __future__ import annotations

import contextlib
import datetime as dt
import io

import pytest
from pyspark.sql import functions as F

from mnemospark.operators.feedback import confidence_after, feedback_summary
from mnemospark.operators.maintenance import token_batches
from mnemospark.sources.tables import distinct_events, latest_memories, table

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_scans_are_pruned_and_filtered(spark):
    text = plan(latest_memories(table(spark, FOLDER, "memories")).select("id", "category"))
    assert "content" not in text and "metadata" not in text
    text = plan(distinct_events(table(spark, FOLDER, "memory_events"), "event_type = 'retrieved'").select("id", "memory_id"))
    assert "EqualTo(event_type,retrieved)" in text and "context" not in text


@pytest.fixture(scope="module")
def hot(spark):
    """One memory with 100,000 ratings, one with three, one with a rating without a time."""
    start = dt.datetime(2025, 1, 1)
    rows = spark.range(100_000).select(F.col("id"), F.lit("hot").alias("memory_id"), (F.lit(start) + F.make_interval(mins=F.col("id").cast("int"))).alias("created_at"), (F.pmod(F.col("id") * 7919, F.lit(101)) / 100).alias("utility"))
    few = spark.createDataFrame([(200_000, "few", start, 1.0), (200_001, "few", start + dt.timedelta(1), 0.0), (200_002, "few", start + dt.timedelta(2), 0.5), (200_003, "untimed", None, 0.7)], "id long, memory_id string, created_at timestamp, utility double")
    return rows.unionByName(few).cache()


def test_smoothed_mean_of_a_hot_memory(spark, hot):
    got = {r.memory_id: r for r in feedback_summary(hot, F.lit(dt.datetime(2026, 1, 1))).collect()}
    smooth = None
    for i in range(100_000):
        u = i * 7919 % 101 / 100
        smooth = u if smooth is None else 0.431 * u + 0.569 * smooth
    assert got["hot"].fb_ewma == pytest.approx(smooth, abs=1e-12) and got["hot"].fb_count == 100_000
    assert got["few"].fb_ewma == pytest.approx(0.539261, abs=1e-6) and got["few"].fb_last == 0.5
    assert got["untimed"].fb_ewma == got["untimed"].fb_last == 0.7
    assert feedback_summary(hot.where("false"), F.lit(dt.datetime(2026, 1, 1))).count() == 0


def test_confidence_of_a_hot_memory(spark, hot):
    start = spark.createDataFrame([("hot", None), ("few", 0.5), ("silent", 0.4)], "memory_id string, confidence double")
    got = {r.memory_id: r.confidence_after for r in confidence_after(hot, start).collect()}
    assert got["few"] == pytest.approx(round(round(round(0.5 + 0.08 * 0.5, 4) * 0.93, 4) + 0.08 * 0.5 * (1 - round(round(0.5 + 0.08 * 0.5, 4) * 0.93, 4)), 4), abs=1e-9)
    assert set(got) == {"hot", "few"} and 0.1 <= got["hot"] <= 0.95


def test_batches_of_a_hot_topic(spark):
    rows = spark.range(50_000).select(F.lit("t").alias("topic_id"), "id", F.lit(3).alias("tokens")).unionByName(spark.createDataFrame([("u", 1, 99), ("u", 2, 1), (None, 3, 5)], "topic_id string, id long, tokens int"))
    got = token_batches(rows, "topic_id", ["id"], 10)
    assert {(r.topic_id, r.id): r.batch for r in got.where("topic_id = 'u' or topic_id is null").collect()} == {("u", 1): 0, ("u", 2): 1, (None, 3): 0}
    assert got.where("topic_id = 't'").agg(F.max("batch")).first()[0] == 16_666
