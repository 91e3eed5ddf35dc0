"""Queries that compare rankings and prepare labels for rankers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.operators import labels as L
from mnemospark.operators import metrics as M
from mnemospark.plans import metric_queries as Q
from mnemospark.plans import parts as P
from mnemospark.plans.feedback_queries import MATCHED, SHOWN, matched, shown_by_recall
from mnemospark.plans.parts import r6


def quality_weighted_miss(spark: SparkSession, folder: str) -> DataFrame:
    """Weight of what each budget misses, by mean utility; budget 0 stands for the mean over the budgets."""
    ranking, truth = Q._both(spark, folder)
    mean = P.feedback(spark, folder).groupBy("memory_id").agg(F.avg("utility").alias("mean"))
    return L.weighted_miss(ranking, truth.where("rel >= 0.5").select("query", "memory_id"), mean).select("budget", r6("miss").alias("miss"))


def quality_discovery(spark: SparkSession, folder: str) -> DataFrame:
    return L.discovery(*Q._both(spark, folder)).withColumn("rate", r6("rate"))


def quality_compared(spark: SparkSession, folder: str) -> DataFrame:
    """Per query: rankings by similarity held against rankings by how often a memory was returned."""
    ranking, truth = Q._both(spark, folder)
    uses = P.events(spark, folder, "event_type = 'retrieved' and memory_id is not null").groupBy("memory_id").agg(F.count(F.lit(1)).alias("uses"))
    order = Window.partitionBy("query").orderBy(F.desc("uses"), "memory_id")
    other = ranking.drop("rank").join(uses, "memory_id").withColumn("rank", F.row_number().over(order))
    found = L.compared(M.ndcg_by_length(ranking, truth, budget=150), M.ndcg_by_length(other, truth, budget=150))
    return found.select("query", r6("before").alias("before"), r6("after").alias("after"), r6("delta").alias("delta"), "outcome")


def quality_rank_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return L.rank_gaps(*Q._both(spark, folder))


def label_levels(spark: SparkSession, folder: str) -> DataFrame:
    return L.label_levels(Q._truth(spark, folder)).select("query", "memory_id", "level")


def label_gains(spark: SparkSession, folder: str) -> DataFrame:
    return L.label_gains(L.label_levels(Q._truth(spark, folder))).select("level", r6("gain").alias("gain"), "rows")


def training_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows to train a ranker on: judged candidates with their labels, and drawn negatives."""
    return L.training_rows(*Q._both(spark, folder)).select("query", "memory_id", r6("rel").alias("rel"), "negative")


def training_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per query, in the order of queries."""
    sizes = L.training_rows(*Q._both(spark, folder)).groupBy("query").agg(F.count(F.lit(1)).alias("rows"))
    return sizes.select("query", "rows")


def quality_floor(spark: SparkSession, folder: str) -> DataFrame:
    """What stays of each ranking above half of its best score."""
    return L.above_floor(Q._ranking(spark, folder)).groupBy("query").agg(F.count(F.lit(1)).alias("kept"), r6(F.min("score")).alias("least"))


def recall_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """Per query: distinct memories that it ever returned, and those of them that are still active."""
    seen = P.events(spark, folder, "event_type = 'retrieved' and query is not null and memory_id is not null").select("query", "memory_id").distinct()
    live = P.active(spark, folder).select(F.col("id").alias("memory_id"), F.lit(1).alias("live"))
    return seen.join(live, "memory_id", "left").groupBy("query").agg(F.count(F.lit(1)).alias("returned"), F.count("live").alias("active"))


def retrieval_lookback(spark: SparkSession, folder: str) -> DataFrame:
    """Per memory the distinct queries of the last thirty days that returned it, of those with two or more."""
    seen = P.events(spark, folder, "event_type = 'retrieved' and query is not null and memory_id is not null").crossJoin(F.broadcast(P.now(spark, folder)))  # one row
    recent = seen.where(F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp")) <= 30 * 86_400_000_000)
    return recent.groupBy("memory_id").agg(F.count_distinct("query").alias("queries")).where("queries >= 2")


def recall_shown(spark: SparkSession, folder: str) -> DataFrame:
    """What each recall returned, ranked by its score."""
    return shown_by_recall(spark, folder).select("recall_id", "memory_id", r6("score").alias("score"), "rank")


def rated_by_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Every rating with the score that the very recall it belongs to gave the memory."""
    ratings = matched(spark, folder).select("feedback_id", "recall_id", "memory_id", "utility")
    return ratings.join(shown_by_recall(spark, folder), ["recall_id", "memory_id"]).select("feedback_id", "recall_id", "memory_id", r6("score").alias("score"), "rank", "utility")


def recall_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    """Where each rated recall stops being useful (a rating of 0.5 or more), and how clear the end is."""
    shown = shown_by_recall(spark, folder)
    useful = matched(spark, folder).where("utility >= 0.5").select("recall_id", "memory_id").distinct().join(shown, ["recall_id", "memory_id"]).select("recall_id", "rank")
    found = L.cutoffs(shown, useful)
    return found.select("recall_id", "cutoff_rank", "total_returned", *[r6(c).alias(c) for c in ("top_score", "last_useful_score", "first_noise_score", "cutoff_ratio", "gap", "gap_ratio")])


QUERIES = {f.__name__: f for f in (
    quality_weighted_miss, quality_discovery, quality_compared, quality_rank_gaps, label_levels, label_gains, training_rows, training_groups, quality_floor, recall_survivors, retrieval_lookback, recall_shown, rated_by_recall, recall_cutoffs,
)}

_MISS = "round(coalesce(sum(w) FILTER (used IS NULL OR used > {b}) / sum(w), 0.0::DOUBLE), 12)"
_LEVELS = """ed AS (SELECT list_distinct(quantile_cont(rel, [0, 1/9, 2/9, 3/9, 4/9, 5/9, 6/9, 7/9, 8/9, 1])) AS es FROM gt WHERE rel > 0),
lv AS (SELECT query, memory_id, rel, CASE WHEN rel > 0 THEN len(list_filter(list_sort(es)[1:len(es) - 1], lambda e: e <= rel)) ELSE 0 END::INTEGER AS level FROM gt, ed)"""
_TRAIN = """ru AS (SELECT rk.query, rk.memory_id, rank, rel FROM rk LEFT JOIN gt ON gt.query = rk.query AND gt.memory_id = rk.memory_id),
jn AS (SELECT query, count(*) AS n FROM ru WHERE rel IS NOT NULL GROUP BY query),
ng AS (SELECT query, memory_id, row_number() OVER (PARTITION BY query ORDER BY md5(query || '|' || memory_id), memory_id) AS at0 FROM ru WHERE rel IS NULL AND rank <= 20),
tn AS (SELECT query, memory_id, CASE WHEN rel < 0.1 THEN 0.0::DOUBLE ELSE rel END AS rel, false AS negative FROM ru WHERE rel IS NOT NULL
  UNION ALL SELECT ng.query, memory_id, 0.0::DOUBLE, true FROM ng JOIN jn ON jn.query = ng.query WHERE at0 <= 3 * n)"""
SQL = {
    "quality_weighted_miss": P.ctes(*Q._BASE, "um AS (SELECT memory_id, avg(utility) AS mean FROM fb GROUP BY memory_id)", "us AS (SELECT query, memory_id, sum(tokens) OVER (PARTITION BY query ORDER BY rank) AS used FROM rk)",
      "wm AS (SELECT gt.query, gt.memory_id, pow(mean, 1.5) AS w, used FROM gt JOIN um ON um.memory_id = gt.memory_id AND mean > 0.1 LEFT JOIN us ON us.query = gt.query AND us.memory_id = gt.memory_id WHERE rel >= 0.5)",
      "ms AS (" + " UNION ALL ".join(f"SELECT {b} AS budget, {_MISS.format(b=b)} AS miss FROM wm" for b in (250, 500, 1000, 2000, 4000, 8000)) + ")")
    + "SELECT budget::INTEGER AS budget, round(miss, 6) AS miss FROM ms UNION ALL SELECT 0, round(avg(miss), 6) FROM ms",
    "quality_discovery": P.ctes(*Q._BASE) + "SELECT count(*) AS high, count(rk.memory_id) AS found, round(count(rk.memory_id)::DOUBLE / count(*), 6) AS rate FROM gt LEFT JOIN rk ON rk.query = gt.query AND rk.memory_id = gt.memory_id WHERE rel >= 0.7",
    "quality_compared": P.ctes(*Q._BASE, "ut AS (SELECT memory_id, count(*) AS uses FROM evt WHERE event_type = 'retrieved' AND memory_id IS NOT NULL GROUP BY 1)",
      "r2 AS (SELECT query, rk.memory_id, tokens, row_number() OVER (PARTITION BY query ORDER BY uses DESC, rk.memory_id) AS rank FROM rk JOIN ut ON ut.memory_id = rk.memory_id)",
      "al AS (SELECT 1 AS w, query, memory_id, tokens, rank FROM rk UNION ALL SELECT 2, query, memory_id, tokens, rank FROM r2)",
      "su AS (SELECT *, sum(tokens) OVER (PARTITION BY w, query ORDER BY rank) AS used FROM al)",
      "dc AS (SELECT w, su.query, sum(coalesce(rel, 0.0::DOUBLE) / log2(rank + 1)) AS dcg, count(*) AS n FROM su LEFT JOIN gt ON gt.query = su.query AND gt.memory_id = su.memory_id WHERE used <= 150 GROUP BY ALL)",
      "bb AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rel DESC, memory_id) AS pos FROM gt)", "ii AS (SELECT w, bb.query, sum(rel / log2(pos + 1)) AS idcg FROM bb JOIN dc ON dc.query = bb.query AND pos <= n GROUP BY ALL)",
      "nd AS (SELECT g.query, w, CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END AS ndcg FROM (SELECT DISTINCT query, w FROM gt, (SELECT unnest([1, 2]) AS w)) g LEFT JOIN dc USING (query, w) LEFT JOIN ii USING (query, w))")
    + "SELECT a.query, round(a.ndcg, 6) AS before, round(b.ndcg, 6) AS after, round(b.ndcg - a.ndcg, 6) AS delta, CASE WHEN b.ndcg - a.ndcg > 1e-6 THEN 'win' WHEN b.ndcg - a.ndcg < -1e-6 THEN 'loss' ELSE 'tie' END AS outcome FROM nd a JOIN nd b ON a.query = b.query AND a.w = 1 AND b.w = 2",
    "quality_rank_gaps": P.ctes(*Q._BASE, "d AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rel DESC, memory_id) AS ideal FROM gt)", "g AS (SELECT rank - ideal AS gap FROM d JOIN rk ON rk.query = d.query AND rk.memory_id = d.memory_id WHERE d.rel >= 0.7 AND rank > ideal)")
    + "SELECT CASE WHEN gap <= 10 THEN 0 WHEN gap <= 25 THEN 1 WHEN gap <= 50 THEN 2 WHEN gap <= 100 THEN 3 WHEN gap <= 250 THEN 4 WHEN gap <= 1000 THEN 5 ELSE 6 END::INTEGER AS bucket, count(*) AS cases FROM g GROUP BY ALL",
    "label_levels": P.ctes(*Q._BASE, _LEVELS) + "SELECT query, memory_id, level FROM lv",
    "label_gains": P.ctes(*Q._BASE, _LEVELS) + "SELECT level, round(avg(rel), 6) AS gain, count(*) AS rows FROM lv GROUP BY level",
    "training_rows": P.ctes(*Q._BASE, _TRAIN) + "SELECT query, memory_id, round(rel, 6) AS rel, negative FROM tn",
    "training_groups": P.ctes(*Q._BASE, _TRAIN) + "SELECT query, count(*) AS rows FROM tn GROUP BY query",
    "quality_floor": P.ctes(P.MEM, P.EVT, Q._RANK.split(",\ngt AS")[0], "m AS (SELECT query, score, max(score) OVER (PARTITION BY query) AS best FROM rk)") + "SELECT query, count(*) AS kept, round(min(score), 6) AS least FROM m WHERE score >= best * 0.5 GROUP BY query",
    "recall_survivors": P.ctes(P.MEM) + "SELECT query, count(*) AS returned, count(act.id) AS active FROM (SELECT DISTINCT query, memory_id FROM memory_events WHERE event_type = 'retrieved' AND id IS NOT NULL AND query IS NOT NULL AND memory_id IS NOT NULL) s LEFT JOIN act ON act.id = s.memory_id GROUP BY query",
    "retrieval_lookback": P.ctes(P.EVT, P.NOW) + "SELECT memory_id, count(DISTINCT query) AS queries FROM evt, clock WHERE event_type = 'retrieved' AND query IS NOT NULL AND memory_id IS NOT NULL AND epoch_us(now) - epoch_us(created_at) <= 30 * 86400000000 GROUP BY memory_id HAVING count(DISTINCT query) >= 2",
    "recall_shown": P.ctes(P.EVT, P.REC, SHOWN) + "SELECT recall_id, memory_id, round(score, 6) AS score, rank::INTEGER AS rank FROM sh2",
    "rated_by_recall": P.ctes(P.EVT, P.FB, P.REC, MATCHED, SHOWN) + "SELECT feedback_id, ma.recall_id, ma.memory_id, round(score, 6) AS score, rank::INTEGER AS rank, utility FROM ma JOIN sh2 ON sh2.recall_id = ma.recall_id AND sh2.memory_id = ma.memory_id",
    "recall_cutoffs": P.ctes(P.EVT, P.FB, P.REC, MATCHED, SHOWN, "l AS (SELECT ma.recall_id, max(rank) AS cut FROM ma JOIN sh2 ON sh2.recall_id = ma.recall_id AND sh2.memory_id = ma.memory_id WHERE utility >= 0.5 GROUP BY 1)",
      "c AS (SELECT sh2.recall_id, max(cut) AS cutoff_rank, count(*) AS total_returned, max(score) AS t, max(score) FILTER (rank = cut) AS a, max(score) FILTER (rank = cut + 1) AS b FROM sh2 JOIN l ON l.recall_id = sh2.recall_id GROUP BY 1)")
    + "SELECT recall_id, cutoff_rank::INTEGER AS cutoff_rank, total_returned, round(t, 6) AS top_score, round(a, 6) AS last_useful_score, round(b, 6) AS first_noise_score, round(CASE WHEN t > 0 THEN a / t ELSE 0.0 END, 6) AS cutoff_ratio, round(a - b, 6) AS gap, round(CASE WHEN a - b IS NOT NULL THEN CASE WHEN t > 0 THEN (a - b) / t ELSE 0.0 END END, 6) AS gap_ratio FROM c",
}
