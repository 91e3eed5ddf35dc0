"""Folds and scores against hand-computed values, and behaviour on dirty input."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mnemospark.config import Scoring
from mnemospark.functions.scores import effective_priority, exploration, reciprocal_rank
from mnemospark.functions.text import normal_themes, strip_secrets
from mnemospark.functions.vectors import cosine, novelty
from mnemospark.operators import feedback as B
from mnemospark.operators import graph as G
from mnemospark.operators import maintenance as M
from mnemospark.operators import metrics as Q
from mnemospark.operators import retrieval as R
from mnemospark.operators.nearest import nearest_before

T0 = dt.datetime(2025, 1, 1)


def at(seconds: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=seconds)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def ratings(spark, rows):
    return spark.createDataFrame([(i, m, "s", at(t), float(u)) for i, (m, t, u) in enumerate(rows)], "id long, memory_id string, session_id string, created_at timestamp, utility double")


def test_smoothed_utility(spark):
    got = B.feedback_summary(ratings(spark, [("a", 1, 1.0), ("a", 3, 0.5), ("a", 2, 0.0)]), F.lit(at(3))).first()
    assert got.fb_ewma == pytest.approx(0.539261, abs=1e-6) and got.fb_last == 0.5 and got.fb_count == 3


def test_prior(spark):
    rows = [(m, i, u) for m, u in zip("abcde", (0.2, 0.4, 0.6, 0.3, 0.5)) for i in (1, 2)]
    got = B.beta_prior(ratings(spark, rows)).first()
    assert (got.prior_mean, got.prior_strength) == (pytest.approx(0.4), pytest.approx(11.0))
    assert tuple(B.beta_prior(ratings(spark, rows).where("false")).first()) == (0.25, 1.0)


def test_exploration(spark):
    value = lambda e, n: one(spark, exploration(F.lit(e).cast("double"), F.lit(n).cast("long"), F.lit(0.4), F.lit(11.0)))
    assert value(None, None) == pytest.approx(1.118794, abs=1e-6)
    assert value(0.539261, 3) == pytest.approx(1.112793, abs=1e-6)


def test_fusion(spark):
    s = Scoring()
    all_first = sum(one(spark, reciprocal_rank(F.lit(0), k, w)) for k, w in ((s.vector_k, s.vector_weight), (s.keyword_k, s.keyword_weight), (s.theme_k, s.theme_weight)))
    assert all_first == pytest.approx(0.138941, abs=1e-6)
    assert one(spark, reciprocal_rank(F.lit(None).cast("int"), 1.0, 1.0)) == 0


def test_decay(spark):
    value = lambda days, flags: one(spark, effective_priority(F.lit(8), F.lit(T0), F.lit(None).cast("double"), F.lit("episodic"), flags, F.lit(T0 + dt.timedelta(days=days))))
    none = F.lit(None).cast("array<string>")
    assert value(30, none) == pytest.approx(4.012609, abs=1e-6)
    assert value(90, none) == pytest.approx(2.8)
    assert value(90, F.array(F.lit("pinned"))) == 8


def test_burstiness(spark):
    rows = [(i, "a", at(t)) for i, t in enumerate((0, 10, 20, 60))] + [(9, "b", at(1)), (10, "c", None)]
    got = {r.memory_id: r.burstiness for r in B.burstiness(spark.createDataFrame(rows, "id int, memory_id string, created_at timestamp")).collect()}
    assert got["a"] == pytest.approx(-0.5) and got["b"] == 0 and "c" not in got


def test_confidence(spark):
    start = spark.createDataFrame([("a", 0.5), ("b", None)], "memory_id string, confidence double")
    got = {r.memory_id: r.confidence_after for r in B.confidence_after(ratings(spark, [("a", 1, 0.9), ("b", 1, 0.0), ("gone", 1, 1.0)]), start).collect()}
    assert got == {"a": pytest.approx(0.536), "b": pytest.approx(0.465)}


def test_recalls_are_matched_to_the_nearest(spark):
    rated = ratings(spark, [("a", 100, 1.0), ("b", 300, 1.0), ("c", 58, 1.0)])
    recalls = spark.createDataFrame([(1, "q", "s", at(95)), (2, "r", "s", at(105)), (3, "x", "other", at(100)), (4, "y", None, at(100)), (5, "z", "s", None)], "id long, query string, session_id string, created_at timestamp")
    got = {r.memory_id: (r.recall_id, r.gap) for r in B.match_recalls(rated, recalls).collect()}
    assert got == {"a": (2, 5.0), "c": (1, 37.0)}


def test_spreading_activation(spark):
    edges = spark.createDataFrame([("1", "A", "B", 1.0, None), ("2", "B", "C", 1.0, None), ("3", "A", "D", 1.0, ["contradiction"]), ("4", None, "A", 1.0, None)], "id string, source_id string, target_id string, weight double, flags array<string>")
    seeds = spark.createDataFrame([("q", "A", 2.0)], "query_id string, memory_id string, score double")
    got = {r.node: r.ppr for r in R.spread_activation(seeds, R.adjacency(edges)).collect()}
    assert got == {"A": pytest.approx(0.803184, abs=1e-5), "B": pytest.approx(0.177632, abs=1e-5), "C": pytest.approx(0.019184, abs=1e-5)}


def test_novelty_and_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, cosine(v(1, 0), v(1, 1))) == pytest.approx(0.7071068)
    assert one(spark, cosine(v(0, 0), v(1, 1))) is None and one(spark, cosine(v(1), v(1, 1))) is None
    assert one(spark, novelty(v(0, 1), v(1, 1), v(1, 0))) == pytest.approx(1.0)
    assert one(spark, novelty(v(0, 1), v(2, 0), v(1, 0))) == 0


def test_secrets_and_themes(spark):
    text = "key sk-abcdefghijklmnopqrstuv and password: hunter2 card 4111111111111111\n-----BEGIN RSA PRIVATE KEY-----\nsk-aaaaaaaaaaaaaaaaaaaaaaaa\n-----END RSA PRIVATE KEY-----"
    clean = one(spark, strip_secrets(F.lit(text)))
    assert clean == "key [REDACTED_API_KEY] and [REDACTED_PASSWORD] card [REDACTED_CREDIT_CARD]\n[REDACTED_PRIVATE_KEY]"
    assert one(spark, strip_secrets(F.lit(clean))) == clean
    assert one(spark, normal_themes(F.array(F.lit("a_b"), F.lit(None), F.lit("  "), F.lit("a b"), F.lit("c")))) == ["a-b", "c"]


def ranking(spark, rows):
    return spark.createDataFrame(rows, "query string, memory_id string, rank int, tokens int")


def test_ranking_quality(spark):
    ranked = ranking(spark, [("q", "a", 1, 40), ("q", "b", 2, 100), ("q", "c", 3, 30), ("r", "z", 1, 10)])
    truth = spark.createDataFrame([("q", "a", 0.2, 40), ("q", "b", 0.5, 100), ("q", "c", 1.0, 30)], "query string, memory_id string, rel double, tokens int")
    assert {r["query"]: r.ndcg for r in Q.ndcg_by_length(ranked, truth, 150).collect()} == {"q": pytest.approx(0.39185, abs=1e-5)}
    ideal = ranking(spark, [("q", "c", 1, 30), ("q", "b", 2, 100), ("q", "a", 3, 40)])
    assert Q.ndcg_by_packing(ideal, truth, 150).first().ndcg == pytest.approx(1.0)
    got = Q.binary_metrics(ranked, truth).first()
    assert (got.mrr, got.hit_1, got.hit_3) == (0.5, 0, 1)
    assert Q.recall_at(ranked, truth, 2).first().micro == 0.5
    assert Q.binary_metrics(ranked, truth.where("false")).count() == 0


def test_rank_statistics(spark):
    df = spark.createDataFrame([(0.1, False, 1.0), (0.4, False, 2.0), (0.4, True, 2.0), (0.9, True, 9.0), (None, True, 1.0)], "score double, y boolean, z double")
    assert Q.auc(df, "score", "y").first().auc == pytest.approx(0.875)
    assert Q.correlations(df, "score", "z").first().spearman == pytest.approx(1.0)
    assert Q.auc(df.where("y"), "score", "y").first().auc is None
    assert Q.value_ranks(df, "score").count() == 3


def test_word_overlap(spark):
    df = spark.createDataFrame([(1, "The cat sat.", "a cat sat down"), (2, None, "x")], "key int, a string, b string")
    assert {r.key: r.f1 for r in Q.token_f1(df, "a", "b").collect()} == {1: pytest.approx(0.8), 2: 0.0}


def test_batches_reset_at_the_budget(spark):
    df = spark.createDataFrame([("t", i, n) for i, n in enumerate((30, 50, 40, 200, 10))], "g string, o int, tokens int")
    assert [r.batch for r in M.token_batches(df, "g", ["o"], 100).orderBy("o").collect()] == [0, 0, 1, 2, 3]


def test_theme_forms(spark):
    counts = spark.createDataFrame([("memory-server", 5), ("MemoryServer", 1), ("memory-servers", 2)], "theme string, memories long")
    assert {(r.variant, r.theme, r.reason) for r in M.theme_variants(counts).collect()} == {("MemoryServer", "memory-server", "form"), ("memory-servers", "memory-server", "ending")}


def test_bootstrap_covers_the_mean(spark):
    df = spark.range(500).select(F.col("id").alias("key"), (F.col("id") % 10).cast("double").alias("v"))
    got = Q.bootstrap_mean(df, "v").first()
    assert got.low < 4.5 < got.high and got.high - got.low < 1.2


def test_nearest_that_ranks_before_needs_no_link(spark):
    v = [1.0] * 384
    w = [1.0] * 380 + [0.9] * 4
    far = [1.0, -1.0] * 192
    rows = [("a", "semantic", 3, v), ("b", "semantic", 5, w), ("c", "semantic", 3, far), ("d", "episodic", 9, v), ("e", "semantic", 3, v)]
    df = spark.createDataFrame([(i, c, -p, x) for i, c, p, x in rows], "id string, kind string, place long, vector array<float>")
    near = nearest_before(df, ties=True, least=0.849, digits=6).collect()
    assert {r.id: r.other for r in near} == {"a": "b", "e": "a"}
    assert {r.id: r.other for r in nearest_before(df).collect()} == {"a": "b", "c": "b", "e": "b"}
    assert {r.id: r.other for r in nearest_before(df, ties=True, least=0.849, digits=6, block_rows=1).collect()} == {"a": "b", "e": "a"}


def test_betweenness_follows_paths_to_their_end(spark):
    edges = spark.createDataFrame([(str(i), f"n{i}", f"n{i + 1}") for i in range(8)] + [("x", "n3", "gone")], "id string, source_id string, target_id string")
    sources = spark.createDataFrame([("n0",)], "memory_id string")
    active = spark.createDataFrame([(f"n{i}",) for i in range(9)] + [("alone",)], "memory_id string")
    got = {r.memory_id: r.betweenness for r in G.betweenness(edges, sources, active).collect()}
    assert got == {f"n{i}": pytest.approx((8 - i) / 36) for i in range(1, 8)}
    assert G.betweenness(edges, sources.where("false"), active).count() == 0
