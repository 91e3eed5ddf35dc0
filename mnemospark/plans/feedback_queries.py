"""Queries over feedback and retrieval events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.functions.scores import exploration
from mnemospark.functions.text import words
from mnemospark.operators import feedback as B
from mnemospark.operators.graph import distinct_edges
from mnemospark.plans import parts as P
from mnemospark.plans.parts import r6
from mnemospark.sources.tables import table


def _summary(spark: SparkSession, folder: str) -> DataFrame:
    timed = P.feedback(spark, folder).crossJoin(F.broadcast(P.now(spark, folder)))  # one row
    return B.feedback_summary(timed, F.col("now"))


def feedback_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _summary(spark, folder).select("memory_id", "fb_count", *[r6(c).alias(c) for c in ("fb_mean", "fb_last", "fb_ewma", "fb_time_weighted")])


def feedback_prior(spark: SparkSession, folder: str) -> DataFrame:
    return B.beta_prior(P.feedback(spark, folder)).select(r6("prior_mean").alias("prior_mean"), r6("prior_strength").alias("prior_strength"))


def feedback_exploration(spark: SparkSession, folder: str) -> DataFrame:
    """Exploration factor of every active memory, rated or not."""
    prior = F.broadcast(B.beta_prior(P.feedback(spark, folder)))  # one row
    joined = P.active(spark, folder).select(F.col("id").alias("memory_id")).join(_summary(spark, folder), "memory_id", "left").crossJoin(prior)
    return joined.select("memory_id", r6(exploration(F.col("fb_ewma"), F.col("fb_count"), F.col("prior_mean"), F.col("prior_strength"))).alias("factor"))


def feedback_confidence(spark: SparkSession, folder: str) -> DataFrame:
    start = P.memories(spark, folder).select(F.col("id").alias("memory_id"), "confidence")
    found = B.confidence_after(P.feedback(spark, folder), start)
    return found.select("memory_id", r6("confidence_before").alias("confidence_before"), F.round("confidence_after", 4).alias("confidence_after"))


def feedback_edge_weights(spark: SparkSession, folder: str) -> DataFrame:
    found = B.edge_weights_after(table(spark, folder, "memory_edges"), P.feedback(spark, folder))
    return found.select("id", "weight_before", r6("weight_after").alias("weight_after"))


def retrieval_burstiness(spark: SparkSession, folder: str) -> DataFrame:
    seen = P.events(spark, folder, "event_type = 'retrieved'")
    return B.burstiness(seen).select("memory_id", "events", r6("burstiness").alias("burstiness"))


def matched(spark: SparkSession, folder: str) -> DataFrame:
    return B.match_recalls(P.feedback(spark, folder), P.recalls(spark, folder))


def shown_by_recall(spark: SparkSession, folder: str) -> DataFrame:
    """(recall_id, memory_id, score, rank) of what each recall returned."""
    seen = P.events(spark, folder, "event_type = 'retrieved' and memory_id is not null and similarity_score is not null")
    best = B.match_shown(seen, P.recalls(spark, folder)).groupBy("recall_id", "memory_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("recall_id").orderBy(F.desc("score"), "memory_id")))


def feedback_matched(spark: SparkSession, folder: str) -> DataFrame:
    return matched(spark, folder).select("feedback_id", "recall_id", "query", r6("gap").alias("gap"))


def feedback_truth(spark: SparkSession, folder: str) -> DataFrame:
    return B.ground_truth(matched(spark, folder)).select("query", "memory_id", r6("rel").alias("rel"), "ratings")


def feedback_disappointed(spark: SparkSession, folder: str) -> DataFrame:
    """Recalls none of whose ratings exceeds 0.2: a failure to rank if the top score was 0.1 or more, else a gap in the store.

    Scores here are fused ranks, whose best is about 0.14; the threshold of 0.25 for scores of another scale would call all of them gaps.
    """
    top = F.get_json_object("context", "$.top_score").cast("double")
    meta = P.events(spark, folder, "event_type = 'recall_meta'").select(F.col("id").alias("recall_id"), top.alias("top_score"))
    worst = matched(spark, folder).groupBy("recall_id").agg(F.max("utility").alias("best"), F.count(F.lit(1)).alias("ratings")).where("best <= 0.2")
    return worst.join(meta, "recall_id").select("recall_id", "ratings", F.when(F.col("top_score") >= 0.1, "retrieval_failure").otherwise("coverage_gap").alias("miss"))


def feedback_co_useful(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of memories that one recall returned and that were both rated 0.7 or more: of the first five of each recall."""
    good = matched(spark, folder).where("utility >= 0.7").groupBy("recall_id", "memory_id").agg(F.min("feedback_id").alias("first"))
    five = good.withColumn("at", F.row_number().over(Window.partitionBy("recall_id").orderBy("first"))).where("at <= 5")
    other = five.select("recall_id", F.col("memory_id").alias("memory_b"))
    return five.select("recall_id", F.col("memory_id").alias("memory_a")).join(other, "recall_id").where("memory_a < memory_b").groupBy("memory_a", "memory_b").agg(F.count(F.lit(1)).alias("recalls"))


def retrieval_queries_per_memory(spark: SparkSession, folder: str) -> DataFrame:
    seen = P.events(spark, folder, "event_type = 'retrieved'")
    return seen.groupBy("memory_id").agg(F.count_distinct("query").alias("queries"), F.count(F.lit(1)).alias("events"), F.count_distinct("session_id").alias("sessions"))


def retrieval_last_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Per query its newest recall and that one's top score."""
    meta = P.events(spark, folder, "event_type = 'recall_meta' and query is not null and created_at is not null")
    newest = meta.groupBy("query").agg(F.max_by(F.struct("id", "context"), F.struct("created_at", "id")).alias("m"), F.count(F.lit(1)).alias("recalls"))
    return newest.select("query", F.col("m.id").alias("recall_id"), "recalls", F.get_json_object("m.context", "$.top_score").cast("double").alias("top_score"))


def session_recency(spark: SparkSession, folder: str) -> DataFrame:
    """Per memory returned: how many seconds earlier it had last been returned in the same session."""
    rows = P.events(spark, folder, "event_type = 'retrieved' and session_id is not null and created_at is not null")
    order = Window.partitionBy("session_id", "memory_id").orderBy("created_at", "id")
    gap = F.unix_micros(F.col("created_at").cast("timestamp")) - F.unix_micros(F.lag("created_at").over(order).cast("timestamp"))
    found = rows.select("id", "memory_id", (gap / 1e6).alias("since"))
    return found.where("since is not null").select("id", "memory_id", r6("since").alias("seconds_since"))


def theme_refinements(spark: SparkSession, folder: str) -> DataFrame:
    """Words of useful queries that a memory's content has, but not its themes: at most three, in order of use."""
    good = matched(spark, folder).where("utility >= 0.6 and query is not null").select("memory_id", F.explode(words(F.col("query"))).alias("term")).where(F.length("term") >= 4)
    counted = good.groupBy("memory_id", "term").agg(F.count(F.lit(1)).alias("n"))
    mem = P.active(spark, folder).select(F.col("id").alias("memory_id"), words(F.col("content")).alias("w"), words(F.array_join(F.coalesce("themes", F.array().cast("array<string>")), " ")).alias("t"))
    new = counted.join(mem, "memory_id").where(F.array_contains("w", F.col("term")) & ~F.array_contains("t", F.col("term")))
    ranked = new.withColumn("at", F.row_number().over(Window.partitionBy("memory_id").orderBy(F.desc("n"), "term"))).where("at <= 3")
    return ranked.select("memory_id", "term", F.col("at").cast("int").alias("at"))


def edges_rated(spark: SparkSession, folder: str) -> DataFrame:
    """Mean utility of the memories at the ends of each kind of link."""
    rated = _summary(spark, folder).select("memory_id", "fb_mean")
    edges = distinct_edges(table(spark, folder, "memory_edges")).where("edge_type is not null")
    ends = edges.select(F.trim(F.lower("edge_type")).alias("kind"), F.explode(F.array("source_id", "target_id")).alias("memory_id"))
    return ends.join(rated, "memory_id").groupBy("kind").agg(F.count(F.lit(1)).alias("ends"), r6(F.avg("fb_mean")).alias("mean_utility"))


QUERIES = {f.__name__: f for f in (
    feedback_summary, feedback_prior, feedback_exploration, feedback_confidence, feedback_edge_weights, retrieval_burstiness, feedback_matched, feedback_truth,
    feedback_disappointed, feedback_co_useful, retrieval_queries_per_memory, retrieval_last_recall, session_recency, theme_refinements, edges_rated,
)}

SUMMARY = """so AS (SELECT memory_id, list(utility ORDER BY created_at NULLS FIRST, id) AS u FROM fb GROUP BY memory_id),
sm AS (SELECT fb.memory_id, count(*) AS fb_count, avg(fb.utility) AS fb_mean, any_value(u[len(u)]) AS fb_last,
  any_value(list_reduce(u, lambda a, x: 0.431::DOUBLE * x + 0.569::DOUBLE * a)) AS fb_ewma,
  sum(exp(-0.01::DOUBLE * (epoch_us(now) - epoch_us(created_at)) / 86400e6) * fb.utility) / sum(exp(-0.01::DOUBLE * (epoch_us(now) - epoch_us(created_at)) / 86400e6)) AS fb_time_weighted
  FROM fb JOIN so ON so.memory_id = fb.memory_id, clock GROUP BY fb.memory_id)"""
PRIOR = """pm AS (SELECT memory_id, avg(utility) AS m, count(*) AS n FROM fb GROUP BY memory_id),
pf AS (SELECT count(*) AS k, avg(m) AS mu, var_pop(m) AS var FROM pm WHERE n >= 2),
prior AS (SELECT CASE WHEN k < 5 THEN coalesce((SELECT avg(utility) FROM fb), 0.25::DOUBLE) ELSE mu END AS prior_mean,
  CASE WHEN k >= 5 AND var > 0 AND var < mu * (1 - mu) THEN mu * (1 - mu) / var - 1 ELSE 1.0::DOUBLE END AS prior_strength FROM pf)"""
MATCHED = """ma AS (SELECT f.id AS feedback_id, f.memory_id, f.utility, r.id AS recall_id, r.query, abs(epoch_us(f.created_at) - epoch_us(r.created_at)) / 1e6 AS gap
  FROM fb f JOIN rec r ON f.session_id = r.session_id AND abs(epoch_us(f.created_at) - epoch_us(r.created_at)) <= 60000000
  QUALIFY row_number() OVER (PARTITION BY f.id ORDER BY abs(epoch_us(f.created_at) - epoch_us(r.created_at)), r.created_at DESC, r.id DESC) = 1)"""
SHOWN = """sn AS (SELECT e.id, e.memory_id, e.similarity_score AS score, min((r.created_at, r.id)) AS r FROM evt e JOIN rec r ON r.session_id = e.session_id AND r.query = e.query AND epoch_us(r.created_at) - epoch_us(e.created_at) BETWEEN 0 AND 60000000
  WHERE e.event_type = 'retrieved' AND e.memory_id IS NOT NULL AND similarity_score IS NOT NULL GROUP BY ALL),
sh2 AS (SELECT *, row_number() OVER (PARTITION BY recall_id ORDER BY score DESC, memory_id) AS rank FROM (SELECT r[2] AS recall_id, memory_id, max(score) AS score FROM sn GROUP BY ALL))"""
TRUTH = """tr AS (SELECT query, memory_id, avg(utility) AS rel, count(*) AS ratings FROM ma WHERE query IS NOT NULL GROUP BY query, memory_id QUALIFY count(*) OVER (PARTITION BY query) >= 3)"""
_STEP = "CASE WHEN x >= 0.5 THEN a + 0.08::DOUBLE * x * (1 - a) WHEN x < 0.1 THEN a * 0.93::DOUBLE ELSE a END"
_CLAMP = f"greatest(0.1::DOUBLE, least(0.95::DOUBLE, {_STEP}))"

SQL = {
    "feedback_summary": P.ctes(P.FB, P.NOW, SUMMARY) + "SELECT memory_id, fb_count, round(fb_mean, 6) AS fb_mean, round(fb_last, 6) AS fb_last, round(fb_ewma, 6) AS fb_ewma, round(fb_time_weighted, 6) AS fb_time_weighted FROM sm",
    "feedback_prior": P.ctes(P.FB, PRIOR) + "SELECT round(prior_mean, 6) AS prior_mean, round(prior_strength, 6) AS prior_strength FROM prior",
    "feedback_exploration": P.ctes(P.MEM, P.FB, P.NOW, SUMMARY, PRIOR) + """SELECT memory_id, round(1 + 0.84::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 6) AS factor FROM (
      SELECT id AS memory_id, coalesce(fb_ewma, 0.0::DOUBLE) * ess + prior_mean * prior_strength AS a, (1 - coalesce(fb_ewma, 0.0::DOUBLE)) * ess + (1 - prior_mean) * prior_strength AS b FROM (
        SELECT act.id, fb_ewma, CASE WHEN fb_count IS NULL THEN 0.0::DOUBLE ELSE least(fb_count::DOUBLE, 1 / (2 * 0.431::DOUBLE - 0.431::DOUBLE * 0.431::DOUBLE)) END AS ess FROM act LEFT JOIN sm ON sm.memory_id = act.id), prior)""",
    "feedback_confidence": P.ctes(P.MEM, P.FB, "so AS (SELECT memory_id, list(utility ORDER BY created_at NULLS FIRST, id) AS u FROM fb GROUP BY memory_id)")
    + f"""SELECT memory_id, round(c, 6) AS confidence_before, round(list_reduce(list_prepend(c, u), lambda a, x: CASE WHEN abs({_CLAMP} - a) > 0.001 THEN round({_CLAMP}, 4) ELSE a END), 4) AS confidence_after
      FROM (SELECT so.memory_id, u, coalesce(confidence, 0.5::DOUBLE) AS c FROM so JOIN mem ON mem.id = so.memory_id)""",
    "feedback_edge_weights": P.ctes(P.FB, """e AS (SELECT id, any_value(source_id) AS s, any_value(target_id) AS t, coalesce(any_value(weight), 0.5) AS w FROM memory_edges WHERE id IS NOT NULL GROUP BY id),
      d AS (SELECT DISTINCT id, w, unnest([s, t]) AS m FROM e)""") + """SELECT id, weight_before, round(list_reduce(list_prepend(weight_before, u), lambda a, x: greatest(0.0::DOUBLE, least(1.0::DOUBLE, a + CASE WHEN x >= 0.5 THEN 0.02::DOUBLE ELSE -0.01::DOUBLE END))), 6) AS weight_after
      FROM (SELECT d.id, any_value(w) AS weight_before, list(utility ORDER BY created_at NULLS FIRST, fb.id) AS u FROM d JOIN fb ON fb.memory_id = d.m GROUP BY d.id)""",
    "retrieval_burstiness": P.ctes(P.EVT) + """SELECT memory_id, count(*) AS events, round(CASE WHEN count(*) < 3 OR coalesce(avg(gap), 1) <= 0 THEN 0.0 ELSE var_pop(gap) / (avg(gap) * avg(gap)) - 1 END, 6) AS burstiness FROM (
      SELECT memory_id, (epoch_us(created_at) - lag(epoch_us(created_at)) OVER (PARTITION BY memory_id ORDER BY created_at, id)) / 1e6 AS gap FROM evt WHERE event_type = 'retrieved' AND created_at IS NOT NULL AND memory_id IS NOT NULL) GROUP BY memory_id""",
    "feedback_matched": P.ctes(P.FB, P.REC, MATCHED) + "SELECT feedback_id, recall_id, query, round(gap, 6) AS gap FROM ma",
    "feedback_truth": P.ctes(P.FB, P.REC, MATCHED, TRUTH) + "SELECT query, memory_id, round(rel, 6) AS rel, ratings FROM tr",
    "feedback_disappointed": P.ctes(P.FB, P.REC, P.EVT, MATCHED) + """SELECT recall_id, ratings, CASE WHEN json_extract_string(context, '$.top_score')::DOUBLE >= 0.1 THEN 'retrieval_failure' ELSE 'coverage_gap' END AS miss
      FROM (SELECT recall_id, count(*) AS ratings FROM ma GROUP BY recall_id HAVING max(utility) <= 0.2) x JOIN evt ON evt.id = x.recall_id WHERE event_type = 'recall_meta'""",
    "feedback_co_useful": P.ctes(P.FB, P.REC, MATCHED, "g AS (SELECT recall_id, memory_id FROM (SELECT recall_id, memory_id, min(feedback_id) AS f FROM ma WHERE utility >= 0.7 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY recall_id ORDER BY f) <= 5)")
    + "SELECT a.memory_id AS memory_a, b.memory_id AS memory_b, count(*) AS recalls FROM g a JOIN g b ON a.recall_id = b.recall_id AND a.memory_id < b.memory_id GROUP BY ALL",
    "retrieval_queries_per_memory": P.ctes(P.EVT) + "SELECT memory_id, count(DISTINCT query) AS queries, count(*) AS events, count(DISTINCT session_id) AS sessions FROM evt WHERE event_type = 'retrieved' GROUP BY memory_id",
    "retrieval_last_recall": P.ctes(P.EVT) + """SELECT query, arg_max(id, (created_at, id)) AS recall_id, count(*) AS recalls, json_extract_string(arg_max(context, (created_at, id)), '$.top_score')::DOUBLE AS top_score
      FROM evt WHERE event_type = 'recall_meta' AND query IS NOT NULL AND created_at IS NOT NULL GROUP BY query""",
    "session_recency": P.ctes(P.EVT) + """SELECT id, memory_id, round(since / 1e6, 6) AS seconds_since FROM (SELECT id, memory_id, epoch_us(created_at) - lag(epoch_us(created_at)) OVER (PARTITION BY session_id, memory_id ORDER BY created_at, id) AS since
      FROM evt WHERE event_type = 'retrieved' AND session_id IS NOT NULL AND created_at IS NOT NULL) WHERE since IS NOT NULL""",
    "theme_refinements": P.ctes(P.MEM, P.FB, P.REC, MATCHED) + f"""SELECT memory_id, term, n::INTEGER AS at FROM (SELECT memory_id, term, row_number() OVER (PARTITION BY memory_id ORDER BY c DESC, term) AS n FROM (
      SELECT memory_id, term, count(*) AS c FROM (SELECT memory_id, unnest({P.WORDS.format('query')}) AS term FROM ma WHERE utility >= 0.6 AND query IS NOT NULL) WHERE length(term) >= 4 GROUP BY ALL) x
      JOIN act ON act.id = x.memory_id WHERE list_contains({P.WORDS.format('content')}, term) AND NOT list_contains({P.WORDS.format("coalesce(array_to_string(themes, ' '), '')")}, term)) WHERE n <= 3""",
    "edges_rated": P.ctes(P.FB, "m AS (SELECT memory_id, avg(utility) AS u FROM fb GROUP BY 1)", "e AS (SELECT id, any_value(source_id) AS s, any_value(target_id) AS t, any_value(edge_type) AS k FROM memory_edges WHERE id IS NOT NULL GROUP BY id)")
    + "SELECT trim(lower(k), ' ') AS kind, count(*) AS ends, round(avg(u), 6) AS mean_utility FROM (SELECT k, unnest([s, t]) AS m FROM e WHERE k IS NOT NULL) d JOIN m ON m.memory_id = d.m GROUP BY 1",
}
