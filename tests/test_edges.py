"""Nulls, ties, repeated rows, empty tables, very long texts and clashing names in the newer operators."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import expansion as X
from mnemospark.operators import labels as L
from mnemospark.operators import recall as C
from mnemospark.operators import upkeep as U
from mnemospark.operators.feedback import match_shown
from mnemospark.operators.retrieval import keyword_channel, vector_channel

T0 = dt.datetime(2025, 3, 1)


def test_since(spark):
    rows = spark.createDataFrame([("7d",), (" 30d ",), ("2025-02-01",), ("2025-02-01T10:00:00",), ("soon",), ("",), (None,), ("99999999999d",)], "s string")
    got = [r[0] for r in rows.select(C.since_time(F.col("s"), F.lit(T0))).collect()]
    assert got[:4] == [T0 - dt.timedelta(7), T0 - dt.timedelta(30), dt.datetime(2025, 2, 1), dt.datetime(2025, 2, 1, 10)] and got[4:] == [None] * 4


def test_time_expressions(spark):
    rows = spark.createDataFrame([("On 3 May 2024, last week and 2 days ago; maybe 1/2/24.",), ("Mayor Aprés 1920",), (None,), ("",), ("today " * 30_000,)], "t string")
    assert [r[0] for r in rows.select(U.time_expressions(F.col("t"))).collect()] == [5, 0, 0, 0, 30_000]


def test_mapped_themes(spark):
    rows = spark.createDataFrame([(["decisions", "decision", "a b", None, " "], "The Memory System works"), (None, ""), ([], "sleep pipeline")], "t array<string>, c string")
    assert [r[0] for r in rows.select(U.mapped_themes(F.col("t"), F.col("c"))).collect()] == [["decision", "a-b", "memory-system"], [], ["sleep-pipeline"]]


def test_decay_after(spark):
    memories = spark.createDataFrame([("a", None, "episodic"), ("b", 0.0, "meta"), ("c", 1.9, None)], "id string, decay_rate double, category string")
    signals = spark.createDataFrame([(1, "a", T0, 1.0), (2, "a", None, -0.5), (3, "b", T0, -1.0), (4, "c", T0, -1.0), (5, "gone", T0, 1.0)], "id long, memory_id string, created_at timestamp, durability double")
    got = {r.memory_id: r.rate_after for r in U.decay_after(signals, memories).collect()}
    assert got == {"a": pytest.approx(0.023 * 1.1 * 0.8), "b": 0.0, "c": 2.0}
    assert U.decay_after(signals.where("false"), memories).count() == 0


def test_dormant(spark):
    kind = "id string, status string, layer string, recall_count int, reflect_count int, created_at timestamp"
    old, new = T0 - dt.timedelta(100), T0 - dt.timedelta(5)
    memories = spark.createDataFrame([("s", "active", "summary", 0, 0, old), ("d1", "active", "detail", 1, None, old), ("d2", "active", "detail", 3, 0, old), ("d3", "active", "detail", 0, 0, new), ("d4", "active", "detail", 0, 0, None), ("d5", "deleted", "detail", 0, 0, old)], kind)
    edges = spark.createDataFrame([("s", f"d{i}", "derived_from") for i in (1, 1, 2, 3, 4, 5)] + [("d2", "d1", "derived_from"), ("s", None, None)], "source_id string, target_id string, edge_type string")
    now = spark.createDataFrame([(T0,)], "now timestamp")
    assert [r.id for r in U.dormant(memories, edges, now).collect()] == ["d1"]


def test_match_shown(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    seen = spark.createDataFrame([(1, "m", "q", "s", at(0), 0.5), (2, "n", "q", "s", at(100), 0.4), (3, "m", None, "s", at(0), 0.1), (4, "m", "q", None, at(0), 0.1), (5, "m", "q", "s", None, 0.1)], "id long, memory_id string, query string, session_id string, created_at timestamp, similarity_score double")
    recalls = spark.createDataFrame([(9, "q", "s", at(1)), (8, "q", "s", at(1)), (7, "q", "s", at(59)), (6, "p", "s", at(0))], "id long, query string, session_id string, created_at timestamp")
    assert {(r.event_id, r.recall_id) for r in match_shown(seen, recalls).collect()} == {(1, 8)}


RANKING = [("q", "a", 1, 0.9, 100), ("q", "b", 2, 0.5, 100), ("q", "c", 3, 0.5, 300), ("r", "a", 1, 0.0, 0)]


@pytest.fixture(scope="module")
def ranked(spark):
    ranking = spark.createDataFrame(RANKING, "query string, memory_id string, rank int, score double, tokens int")
    truth = spark.createDataFrame([("q", "b", 1.0), ("q", "x", 0.8), ("q", "c", 0.05), ("none", "a", 0.0)], "query string, memory_id string, rel double")
    return ranking, truth


def test_misses(spark, ranked):
    ranking, truth = ranked
    utility = spark.createDataFrame([("b", 0.25), ("x", 1.0), ("c", 0.1), ("y", None)], "memory_id string, mean double")
    got = {r.budget: r.miss for r in L.weighted_miss(ranking, truth.select("query", "memory_id"), utility, budgets=(150, 250)).collect()}
    assert got == {150: 1.0, 250: pytest.approx(1 / 1.125), 0: pytest.approx((1 + 1 / 1.125) / 2)}
    assert {r.miss for r in L.weighted_miss(ranking, truth.where("false").select("query", "memory_id"), utility).collect()} == {0.0}
    assert L.discovery(ranking, truth).first().asDict() == {"high": 2, "found": 1, "rate": 0.5} and L.discovery(ranking, truth.where("false")).first().rate == 0.0


def test_labels(spark, ranked):
    _, truth = ranked
    assert {r.memory_id: r.level for r in L.label_levels(truth, 4).collect() if r.query == "q"} == {"c": 1, "x": 2, "b": 3}
    assert {r.memory_id: r.level for r in L.label_levels(truth, 100).collect()} == {"b": 100, "x": 80, "c": 5, "a": 0}
    same = truth.where("rel > 0").withColumn("rel", F.lit(0.5))
    assert {r.level for r in L.label_levels(same).collect()} == {0} and L.label_levels(truth.where("false")).count() == 0
    assert {r.level: r.gain for r in L.label_gains(L.label_levels(truth, 4)).collect()} == {0: 0.0, 1: 0.05, 2: 0.8, 3: 1.0}


def test_training_rows(spark, ranked):
    got = {(r.query, r.memory_id): (r.rel, r.negative) for r in L.training_rows(*ranked).collect()}
    assert got == {("q", "b"): (1.0, False), ("q", "c"): (0.0, False), ("q", "a"): (0.0, True)}
    assert [(r.query, r.memory_id) for r in L.above_floor(ranked[0]).orderBy("query", "memory_id").collect()] == [("q", "a"), ("q", "b"), ("q", "c"), ("r", "a")]


def test_cutoffs(spark):
    shown = spark.createDataFrame([(1, 1, 0.8), (1, 2, 0.4), (1, 3, 0.1), (2, 1, 0.0), (3, 1, 0.5)], "recall_id long, rank int, score double")
    useful = spark.createDataFrame([(1, 2), (1, 1), (2, 1)], "recall_id long, rank int")
    got = {r.recall_id: r for r in L.cutoffs(shown, useful).collect()}
    assert set(got) == {1, 2} and got[1].cutoff_rank == 2 and got[1].gap == pytest.approx(0.3) and got[1].cutoff_ratio == pytest.approx(0.5)
    assert got[2].first_noise_score is None and got[2].gap is None and got[2].cutoff_ratio == 0.0


def _memories(spark):
    kind = "id string, summary string, themes array<string>, session_id string, created_at timestamp"
    rows = [(f"m{i:02}", "kiln glaze notes" if i % 2 else "kiln schedule", ["kiln"], "s" if i < 12 else None, T0 + dt.timedelta(i)) for i in range(14)]
    return spark.createDataFrame(rows + [("null", None, None, None, None), ("long", "kiln " * 50_000, None, "s", None)], kind)


def test_session_cut_after_the_pool(spark):
    memories = _memories(spark)
    seeds = spark.createDataFrame([(1, "m00")], "query_id long, memory_id string")
    pool = spark.createDataFrame([(1, f"m{i:02}") for i in range(3, 12)], "query_id long, memory_id string")
    assert {r.memory_id for r in X.by_session(seeds, memories, pool, per_seed=2).collect()} == {"m02", "m01"}


def test_keyword_search_without_the_pool(spark):
    queries = spark.createDataFrame([(1, "kiln glaze"), (2, None), (3, "")], "query_id long, query string")
    memories = _memories(spark)
    first = {r.memory_id for r in keyword_channel(queries, memories, k=3).collect()}
    rest = {r.memory_id for r in keyword_channel(queries, memories, k=3, without=spark.createDataFrame([(1, m) for m in first], "query_id long, memory_id string")).collect()}
    assert len(first) == len(rest) == 3 and not first & rest


def test_word_pairs(spark):
    queries = spark.createDataFrame([(1, "what about the kiln and glaze notes"), (2, "kiln"), (3, None)], "query_id long, query string")
    assert [(r.place, r.query) for r in X.word_pairs(queries).orderBy("place").collect()] == [(0, "kiln glaze"), (1, "kiln notes"), (2, "glaze notes")]
    empty = spark.createDataFrame([], "query_id long, memory_id string")
    found = X.by_word_pairs(queries, _memories(spark), empty).collect()
    assert {r.memory_id for r in found} == {f"m{i:02}" for i in range(1, 14, 2)} and found[0].score == pytest.approx(1 / 60 + 1 / 60 + 1 / 60, abs=1e-2)


def test_vectors_of_all_kinds(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("zero", [0.0, 0.0]), ("null", None), ("hole", [None, 1.0]), ("three", [1.0, 0.0, 0.0])], "id string, vector array<double>")
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "query_id long, vector array<double>")
    assert [(r.query_id, r.id, r.rank) for r in vector_channel(queries, vectors, k=5).orderBy("rank").collect()] == [(1, "a", 0), (1, "b", 1)]
    assert vector_channel(queries.where("false"), vectors, k=5).count() == 0
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, vector array<double>")
    seeds = spark.createDataFrame([(1, "v")], "query_id long, memory_id string")
    held = spark.createDataFrame([("v", [0.0, 1.0])], "memory_id string, embedding array<double>")
    moved = {r.query_id: r.vector for r in X.toward_centroid(asked, seeds, held).collect()}
    assert moved[2] == [0.0, 1.0] and moved[1] == pytest.approx([0.7 / 0.58**0.5, 0.3 / 0.58**0.5])


def test_density(spark):
    pool = spark.createDataFrame([(1, "m00"), (1, "m02"), (1, "m05"), (1, "m13"), (1, "gone"), (2, "m01")], "query_id long, memory_id string")
    got = {(r.query_id, r.memory_id): r.neighbours for r in C.pool_density(pool, _memories(spark)).collect()}
    assert got == {(1, "m00"): 1, (1, "m02"): 1, (1, "m05"): 0, (1, "m13"): 0, (1, "gone"): 0, (2, "m01"): 0}


def test_choice_of_features(spark):
    from mnemospark.operators.selection import correlation_filter, correlations, most_relevant

    rows = spark.range(200).selectExpr("id y", "id + id % 7 a", "id * 2 b", "id % 7 c", "1 d", "if(id < 3, null, id % 5) e")
    table = [tuple(r) for r in correlations(rows, ["y", "a", "b", "c", "d", "e"]).collect()]
    assert len(table) == 15 and {c for a, b, c in table if "d" in (a, b)} == {None}
    assert most_relevant(table, "y", 2) == ["b", "a"] and set(most_relevant(table, "y", 9)) == {"a", "b", "c", "d", "e"}
    assert correlation_filter(table, {"a": 0.5, "b": 0.9, "c": 0.1, "d": 0.0}) == ["b", "c", "d"]
    assert [r.correlation for r in correlations(rows.where("false"), ["y", "a"]).collect()] == [None]
