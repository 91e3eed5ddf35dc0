from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from mnemospark.functions.text import auto_summary, compact_line
from mnemospark.operators.maintenance import changes, near_duplicates
from mnemospark.operators.metrics import isotonic
from mnemospark.sources import io
from mnemospark.sources.tables import distinct_events, latest_memories


def test_relevance_and_lines(spark, tmp_path):
    (tmp_path / "gt.json").write_text(json.dumps({"q": {"a": 1.5, "b": None, "c": 0.2}, "r": {}}))
    assert {tuple(r) for r in io.read_relevance(spark, str(tmp_path / "gt.json")).collect()} == {("q", "a", 1.0), ("q", "c", 0.2)}
    df = spark.createDataFrame([("a", None), ("b", 2)], "k string, v int")
    io.write_lines(df, str(tmp_path / "lines"))
    assert {tuple(r) for r in io.read_lines(spark, str(tmp_path / "lines"), "k string, v int").collect()} == {("a", None), ("b", 2)}


def test_snapshots(spark, tmp_path):
    for i in range(5):
        df = spark.range(i + 1)
        io.write_snapshot(df if i < 4 else df.withColumn("late", F.lit(1)), str(tmp_path / "s"), f"2025-01-0{i + 1}")
    got = io.newest_snapshots(spark, str(tmp_path / "s"))
    assert {r.snapshot: r["count"] for r in got.groupBy("snapshot").count().collect()} == {"2025-01-03": 3, "2025-01-04": 4, "2025-01-05": 5}
    assert "late" in got.columns


def test_dates(spark):
    texts = ["1:56 pm on 8 May, 2023", "8 May, 2023", "2023-05-08 13:56:00", "soon", None]
    got = [r.v for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(io.conversation_date(F.col("t")).alias("v")).collect()]
    assert got[0] == dt.datetime(2023, 5, 8, 13, 56) and got[1] == dt.datetime(2023, 5, 8) and got[2] == dt.datetime(2023, 5, 8, 13, 56) and got[3] == got[4] == dt.datetime(2023, 1, 1)


def test_newest_snapshot_of_a_memory(spark):
    schema = "id string, last_accessed timestamp, recall_count int, startup_count int, reflect_count int, status string, summary string, metadata map<string,string>"
    t = dt.datetime(2025, 1, 1)
    rows = [("a", t, 1, 0, 0, "active", None, {}), ("a", t + dt.timedelta(1), 2, 0, 0, "active", "new", {"k": "v"}), ("b", None, 0, 0, 0, "active", "x", None), (None, t, 0, 0, 0, "active", "y", {})]
    got = {r.id: r.summary for r in latest_memories(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": "new", "b": "x"}
    assert distinct_events(spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "id long, memory_id string")).count() == 1


def test_text_lines(spark):
    df = spark.createDataFrame([("meta", None, "c" * 100, ["a", "b", "c", "d", "e", "f"]), ("meta", "s", "c", ["question"]), ("meta", "", "c", None)], "category string, summary string, content string, themes array<string>")
    got = [r.v for r in df.select(compact_line(*map(F.col, ("category", "summary", "content", "themes"))).alias("v")).collect()]
    assert got == ["[meta] " + "c" * 80 + " (a, b, c, d, e, ...)", "[?] s (question)", "[meta] c"]
    short = spark.createDataFrame([("One. Two.", 5), ("x" * 200, 5), ("long", 60)], "c string, n int")
    assert [r.v for r in short.select(auto_summary(F.col("c"), F.col("n")).alias("v")).collect()] == ["One.", "x" * 80, None]


def test_duplicates_and_changes(spark):
    mem = spark.createDataFrame([("a", "x", 5, "active"), ("b", "x", 7, "active"), ("c", "y", 9, "active"), ("d", "x", 1, "deleted")], "id string, category string, base_priority int, status string")
    cos = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.99), ("a", "d", 1.0), ("b", "c", None)], "low string, high string, cosine double")
    assert [tuple(r) for r in near_duplicates(cos, mem).collect()] == [("a", "b", 0.1)]
    got = {r.status: r.delta for r in changes(mem, mem.where("id <> 'a'"), "status").collect()}
    assert got == {"active": -1, "deleted": 0}


def test_isotonic(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0), (0.4, 1), (None, 1)], "s double, y int")
    got = [(r.score, r.rate) for r in isotonic(df, "s", "y").orderBy("score").collect()]
    assert got == [(0.1, 0.0), (0.2, 0.5), (0.3, 0.5), (0.4, 1.0)]
    assert isotonic(df.where("false"), "s", "y").count() == 0
