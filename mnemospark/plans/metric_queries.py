"""Queries that judge rankings: what past recalls returned, held against what ratings say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.operators import metrics as M
from mnemospark.operators.feedback import ground_truth
from mnemospark.plans import parts as P
from mnemospark.plans.feedback_queries import MATCHED, SHOWN, TRUTH, matched, shown_by_recall
from mnemospark.plans.parts import r6
from mnemospark.runtime import checkpoint

BUDGETS = (50, 100, 200, 400)


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    return P.memories(spark, folder).select(F.col("id").alias("memory_id"), F.coalesce("token_count", F.lit(0)).alias("tokens"))


def _ranking(spark: SparkSession, folder: str) -> DataFrame:
    seen = P.events(spark, folder, "event_type = 'retrieved' and query is not null and memory_id is not null and similarity_score is not null")
    best = seen.groupBy("query", "memory_id").agg(F.max("similarity_score").alias("score"))
    placed = best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "memory_id")))
    return placed.join(_tokens(spark, folder), "memory_id", "left").fillna(0, ["tokens"])


def _truth(spark: SparkSession, folder: str) -> DataFrame:
    rel = ground_truth(matched(spark, folder)).select("query", "memory_id", F.round("rel", 9).alias("rel"))
    return rel.join(_tokens(spark, folder), "memory_id", "left").fillna(0, ["tokens"])


def _both(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return _ranking(spark, folder), checkpoint(_truth(spark, folder))


def quality_binary(spark: SparkSession, folder: str) -> DataFrame:
    found = M.binary_metrics(*_both(spark, folder))
    return found.select("query", r6("mrr").alias("mrr"), *[c for c in found.columns if c.startswith("hit_")], r6("ndcg10").alias("ndcg10"))


def quality_recall(spark: SparkSession, folder: str) -> DataFrame:
    return M.recall_at(*_both(spark, folder), k=5).select(r6("micro").alias("micro"), r6("macro").alias("macro"), "queries")


def quality_ndcg_length(spark: SparkSession, folder: str) -> DataFrame:
    return M.ndcg_by_length(*_both(spark, folder), budget=150).select("query", r6("ndcg").alias("ndcg"))


def quality_ndcg_packing(spark: SparkSession, folder: str) -> DataFrame:
    return M.ndcg_by_packing(*_both(spark, folder), budget=150).select("query", r6("ndcg").alias("ndcg"))


def quality_graded_recall(spark: SparkSession, folder: str) -> DataFrame:
    return M.graded_recall(*_both(spark, folder), budget=200).select(r6("graded_recall").alias("graded_recall"), "queries")


def quality_at_budgets(spark: SparkSession, folder: str) -> DataFrame:
    found = M.at_budgets(*_both(spark, folder), budgets=BUDGETS)
    return found.select("budget", *[r6(c).alias(c) for c in ("miss_any", "miss_best", "mrr")], "queries")


def quality_cliff(spark: SparkSession, folder: str) -> DataFrame:
    return M.cliff(_ranking(spark, folder))


def quality_confusions(spark: SparkSession, folder: str) -> DataFrame:
    """Memories rated 0.7 or more that were ranked fifth or lower: per memory the worst case."""
    ranking, truth = _both(spark, folder)
    bad = ranking.join(truth.where("rel >= 0.7").select("query", "memory_id", "rel"), ["query", "memory_id"]).where("rank > 5")
    severity = F.round(F.col("rel") * (F.col("rank") - 1), 6)
    worst = bad.withColumn("severity", severity).groupBy("memory_id").agg(F.min_by(F.struct("query", "severity"), F.struct(-F.col("severity"), "query")).alias("w"), F.count(F.lit(1)).alias("cases"))
    return worst.select("memory_id", "w.query", "w.severity", "cases")


def _rated(spark: SparkSession, folder: str) -> DataFrame:
    """Every rating with the score that its recall gave the memory."""
    return matched(spark, folder).join(shown_by_recall(spark, folder), ["recall_id", "memory_id"]).select(F.col("feedback_id").alias("key"), "memory_id", "score", "utility")


def rating_correlation(spark: SparkSession, folder: str) -> DataFrame:
    return M.correlations(_rated(spark, folder), "score", "utility").select("n", r6("pearson").alias("pearson"), r6("spearman").alias("spearman"))


def rating_auc(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rated(spark, folder).withColumn("used", F.col("utility") >= 0.5)
    return M.auc(rows, "score", "used").select("pos", "neg", r6("auc").alias("auc"), r6("point_biserial").alias("point_biserial"))


def rating_thresholds(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rated(spark, folder).withColumn("used", F.col("utility") >= 0.5)
    found = M.threshold_sweep(rows, "score", "used")
    return found.select("threshold", "surfaced", *[r6(c).alias(c) for c in ("precision", "recall", "f_beta")])


def rating_quadrants(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rated(spark, folder).select((F.col("score") >= 0.1).alias("scored_high"), (F.col("utility") >= 0.5).alias("useful"))
    return rows.groupBy("scored_high", "useful").agg(F.count(F.lit(1)).alias("ratings"))


def rating_mean_interval(spark: SparkSession, folder: str) -> DataFrame:
    """Mean utility with a bootstrap interval."""
    rows = P.feedback(spark, folder).select(F.col("id").alias("key"), "utility")
    return M.bootstrap_mean(rows, "utility").select(r6("mean").alias("mean"), "n", r6("low").alias("low"), r6("high").alias("high"))


def rating_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A hundred ratings drawn by utility without replacement."""
    return M.weighted_sample(P.feedback(spark, folder).select(F.col("id").alias("key"), "memory_id", "utility"), "utility", 100)


def text_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """How well a summary's words stand for its memory's content."""
    pairs = P.active(spark, folder).select(F.col("id").alias("key"), "summary", "content")
    return M.token_f1(pairs, "summary", "content").select(F.col("key").alias("id"), r6("f1").alias("f1"))


def decay_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Per category: decay of mean utility with a memory's age, fitted to the log of three-day means."""
    born = P.memories(spark, folder).select(F.col("id").alias("memory_id"), "category", F.col("created_at").alias("born"))
    aged = P.feedback(spark, folder).join(born, "memory_id").select("category", "utility", ((F.unix_micros(F.col("created_at").cast("timestamp")) - F.unix_micros(F.col("born").cast("timestamp"))) / 86_400e6).alias("age")).where("age >= 0")
    binned = aged.groupBy("category", F.floor(F.col("age") / 3).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("utility").alias("mean")).where("n >= 3 and mean > 0")
    per = binned.groupBy("category").agg(F.count(F.lit(1)).alias("bins"), F.sum("n").alias("ratings"), F.regr_slope(F.log("mean"), F.col("bin") * 3 + 1.5).alias("slope"))
    return per.where("bins >= 3").select("category", "bins", "ratings", r6(-F.col("slope")).alias("rate"))


def rating_isotonic(spark: SparkSession, folder: str) -> DataFrame:
    """How often a memory of a given score is found useful, as a non-decreasing step function."""
    found = M.isotonic(_rated(spark, folder).withColumn("used", F.col("utility") >= 0.5), "score", "used")
    return found.select(F.round("score", 4).alias("score"), r6("rate").alias("rate"))


QUERIES = {f.__name__: f for f in (
    rating_isotonic, quality_binary, quality_recall, quality_ndcg_length, quality_ndcg_packing, quality_graded_recall, quality_at_budgets, quality_cliff, quality_confusions,
    rating_correlation, rating_auc, rating_thresholds, rating_quadrants, rating_mean_interval, rating_sample, text_overlap, decay_fit,
)}

_RANK = """rk AS (SELECT query, memory_id, score, coalesce(token_count, 0) AS tokens, row_number() OVER (PARTITION BY query ORDER BY score DESC, memory_id) AS rank FROM (
  SELECT query, memory_id, max(similarity_score) AS score FROM evt WHERE event_type = 'retrieved' AND query IS NOT NULL AND memory_id IS NOT NULL AND similarity_score IS NOT NULL GROUP BY query, memory_id) x LEFT JOIN mem ON mem.id = x.memory_id),
gt AS (SELECT query, memory_id, round(rel, 9) AS rel, coalesce(token_count, 0) AS tokens FROM tr LEFT JOIN mem ON mem.id = tr.memory_id)"""
_BASE = (P.MEM, P.EVT, P.FB, P.REC, MATCHED, TRUTH, _RANK)
_SHOWN = """sh AS (SELECT rk.query, rk.memory_id, rk.rank, coalesce(gt.rel, 0.0::DOUBLE) AS rel, used FROM (SELECT *, sum(tokens) OVER (PARTITION BY query ORDER BY rank) AS used FROM rk) rk
  LEFT JOIN gt ON gt.query = rk.query AND gt.memory_id = rk.memory_id WHERE rk.query IN (SELECT query FROM gt))"""
_RATED = "ra AS (SELECT feedback_id AS key, ma.memory_id, score, utility FROM ma JOIN sh2 ON sh2.recall_id = ma.recall_id AND sh2.memory_id = ma.memory_id)"
_RBASE = (P.EVT, P.FB, P.REC, MATCHED, SHOWN, _RATED)
_AVG = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2)"
_CLEAN = r"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}\s]', '', 'g'), '\s+'), lambda w: w <> '' AND w NOT IN ('a', 'an', 'the', 'and'))"

SQL = {
    "quality_binary": P.ctes(*_BASE, "rl AS (SELECT * FROM gt WHERE rel >= 0.5)", "n AS (SELECT query, count(*) AS n FROM rl GROUP BY query)", "f AS (SELECT rk.query, min(rank) AS first, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) END) AS dcg FROM rk JOIN rl ON rl.query = rk.query AND rl.memory_id = rk.memory_id GROUP BY rk.query)")
    + "SELECT n.query, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, " + ", ".join(f"coalesce((first <= {k})::INTEGER, 0) AS hit_{k}" for k in (1, 3, 5, 10, 20)) + ", round(coalesce(dcg, 0.0::DOUBLE) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg10 FROM n LEFT JOIN f ON f.query = n.query",
    "quality_recall": P.ctes(*_BASE, "p AS (SELECT gt.query, count(*) AS n, count(rk.rank) AS h FROM gt LEFT JOIN rk ON rk.query = gt.query AND rk.memory_id = gt.memory_id AND rk.rank <= 5 WHERE rel >= 0.5 GROUP BY gt.query)")
    + "SELECT round(sum(h)::DOUBLE / sum(n), 6) AS micro, round(avg(h::DOUBLE / n), 6) AS macro, count(*) AS queries FROM p",
    "quality_ndcg_length": P.ctes(*_BASE, _SHOWN, "d AS (SELECT query, sum(rel / log2(rank + 1)) AS dcg, count(*) AS n FROM sh WHERE used <= 150 GROUP BY query)", "b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rel DESC, memory_id) AS pos FROM gt)", "i AS (SELECT b.query, sum(rel / log2(pos + 1)) AS idcg FROM b JOIN d ON d.query = b.query AND pos <= n GROUP BY b.query)")
    + "SELECT g.query, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END, 6) AS ndcg FROM (SELECT DISTINCT query FROM gt) g LEFT JOIN d ON d.query = g.query LEFT JOIN i ON i.query = g.query",
    "quality_ndcg_packing": "WITH RECURSIVE " + ", ".join((*_BASE, _SHOWN)) + """, d AS (SELECT query, sum(rel / log2(rank + 1)) AS dcg FROM sh WHERE used <= 150 GROUP BY query),
      b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rel DESC, memory_id) AS pos FROM gt),
      w(query, pos, used, n, gain) AS (SELECT DISTINCT query, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0.0::DOUBLE FROM b UNION ALL
        SELECT b.query, b.pos, CASE WHEN w.used + b.tokens <= 150 THEN w.used + b.tokens ELSE w.used END, CASE WHEN w.used + b.tokens <= 150 THEN w.n + 1 ELSE w.n END, CASE WHEN w.used + b.tokens <= 150 THEN w.gain + b.rel / log2(w.n + 2) ELSE w.gain END
        FROM w JOIN b ON b.query = w.query AND b.pos = w.pos + 1)
      SELECT i.query, round(CASE WHEN idcg > 0 THEN coalesce(dcg, 0.0::DOUBLE) / idcg ELSE 0.0 END, 6) AS ndcg FROM (SELECT query, arg_max(gain, pos) AS idcg FROM w GROUP BY query) i LEFT JOIN d ON d.query = i.query""",
    "quality_graded_recall": P.ctes(*_BASE, _SHOWN, "g AS (SELECT query, count(*) AS n, sum(rel) AS got FROM sh WHERE used <= 200 AND rel >= 0.5 GROUP BY query)", "b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rel DESC, memory_id) AS pos FROM gt)", "i AS (SELECT b.query, sum(rel) AS best, any_value(got) AS got FROM b JOIN g ON g.query = b.query AND pos <= n GROUP BY b.query)")
    + "SELECT round(sum(got) / sum(best), 6) AS graded_recall, count(*) AS queries FROM i",
    "quality_at_budgets": P.ctes(*_BASE, _SHOWN, "bs AS (SELECT query, arg_min(memory_id, (-rel, memory_id)) AS best FROM gt GROUP BY query HAVING max(rel) >= 0.5)",
      "f AS (SELECT bs.query, arg_min(used, rank) FILTER (rel >= 0.5) AS au, min(rank) FILTER (rel >= 0.5) AS ar, min(used) FILTER (memory_id = best) AS bu FROM bs LEFT JOIN sh ON sh.query = bs.query GROUP BY bs.query)")
    + "SELECT budget, round(avg((NOT coalesce(au <= budget, false))::INTEGER), 6) AS miss_any, round(avg((NOT coalesce(bu <= budget, false))::INTEGER), 6) AS miss_best, round(avg(CASE WHEN au <= budget THEN 1.0::DOUBLE / ar ELSE 0.0 END), 6) AS mrr, count(*) AS queries FROM f, (SELECT unnest([50, 100, 200, 400]) AS budget) GROUP BY budget",
    "quality_cliff": P.ctes(*_BASE, "y AS (SELECT query, rank, ln(rank) AS x, CASE WHEN max(score) OVER (PARTITION BY query) > 0 THEN score / max(score) OVER (PARTITION BY query) ELSE 0.0 END AS y FROM rk)",
      """z AS (SELECT query, rank, x, y, count(y) OVER w AS n, regr_slope(y, x) OVER w AS b, regr_intercept(y, x) OVER w AS a, regr_syy(y, x) OVER w AS syy, regr_sxy(y, x) OVER w AS sxy FROM y WINDOW w AS (PARTITION BY query ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
    + "SELECT query, coalesce(min(rank - 1) FILTER (n >= 5 AND a + b * x - y > 2 * greatest(sqrt(greatest(0.0::DOUBLE, syy - b * sxy) / n), 0.005::DOUBLE)), max(rank))::INTEGER AS cut FROM z GROUP BY query",
    "quality_confusions": P.ctes(*_BASE, "c AS (SELECT rk.memory_id, rk.query, round(rel * (rank - 1), 6) AS severity FROM rk JOIN gt ON gt.query = rk.query AND gt.memory_id = rk.memory_id WHERE rel >= 0.7 AND rank > 5)")
    + "SELECT memory_id, arg_min(query, (-severity, query)) AS query, max(severity) AS severity, count(*) AS cases FROM c GROUP BY memory_id",
    "rating_correlation": P.ctes(*_RBASE, f"a AS (SELECT score, utility, {_AVG.format(c='score')} AS rx, {_AVG.format(c='utility')} AS ry FROM ra)") + "SELECT count(*) AS n, round(corr(score, utility), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM a",
    "rating_auc": P.ctes(*_RBASE, f"a AS (SELECT score, utility >= 0.5 AS y, {_AVG.format(c='score')} AS r FROM ra)")
    + "SELECT pos, neg, round((ranks - pos * (pos + 1) / 2) / (pos * neg), 6) AS auc, point_biserial FROM (SELECT count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg, sum(r) FILTER (y) AS ranks, round(corr(score, y::INTEGER), 6) AS point_biserial FROM a)",
    "rating_thresholds": P.ctes(*_RBASE, "a AS (SELECT score, (utility >= 0.5)::INTEGER AS y FROM ra)", "e AS (SELECT min(score) AS lo, max(score) AS hi, sum(y) AS p FROM a)", "g AS (SELECT p, round(lo + (hi - lo) * i / 50, 9) AS t FROM e, (SELECT unnest(range(0, 51)) AS i))",
      "s AS (SELECT t, any_value(p) AS p, count(score) AS n, coalesce(sum(y), 0) AS tp FROM g LEFT JOIN a ON score >= t GROUP BY t)", "m AS (SELECT t, n, CASE WHEN n = 0 THEN 1.0::DOUBLE ELSE tp::DOUBLE / n END AS pr, CASE WHEN p > 0 THEN tp::DOUBLE / p ELSE 0.0::DOUBLE END AS re FROM s)")
    + "SELECT t AS threshold, n AS surfaced, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN 4 * pr + re > 0 THEN 5 * pr * re / (4 * pr + re) ELSE 0.0 END, 6) AS f_beta FROM m",
    "rating_quadrants": P.ctes(*_RBASE) + "SELECT score >= 0.1 AS scored_high, utility >= 0.5 AS useful, count(*) AS ratings FROM ra GROUP BY ALL",
    "text_overlap": P.ctes(P.MEM, f"s AS (SELECT id, {_CLEAN.format('summary')} AS a, {_CLEAN.format('content')} AS b FROM act)", "x AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(a) AS w FROM s) GROUP BY ALL)", "y AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(b) AS w FROM s) GROUP BY ALL)", "c AS (SELECT x.id, sum(least(x.n, y.n)) AS c FROM x JOIN y ON x.id = y.id AND x.w = y.w GROUP BY x.id)")
    + "SELECT s.id, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(c, 0) / (len(a) + len(b)) END, 6) AS f1 FROM s LEFT JOIN c ON c.id = s.id",
    "decay_fit": P.ctes(P.MEM, P.FB, "a AS (SELECT category, utility, (epoch_us(fb.created_at) - epoch_us(mem.created_at)) / 86400e6 AS age FROM fb JOIN mem ON mem.id = fb.memory_id)", "b AS (SELECT category, floor(age / 3)::INTEGER AS bin, count(*) AS n, avg(utility) AS mean FROM a WHERE age >= 0 GROUP BY ALL HAVING count(*) >= 3 AND avg(utility) > 0)")
    + "SELECT category, count(*) AS bins, sum(n)::BIGINT AS ratings, round(-regr_slope(ln(mean), bin * 3 + 1.5::DOUBLE), 6) AS rate FROM b GROUP BY category HAVING count(*) >= 3",
}

_DRAWS = "(" + " + ".join(f"(u >= {x})::INTEGER" for x in M.POISSON) + ")"
SQL |= {
    "rating_mean_interval": P.ctes(P.FB, "dr AS (SELECT utility AS v, c * 8 + i AS b, ('0x' || substr(md5(concat_ws('|', id, c, 1729)), (i * 4 + 1)::BIGINT, 4))::INTEGER AS u FROM fb, (SELECT unnest(range(0, 25)) AS c), (SELECT unnest(range(0, 8)) AS i))",
      f"mn AS (SELECT b, sum({_DRAWS} * v) / sum({_DRAWS}) AS m FROM dr GROUP BY b)", "so AS (SELECT list_sort(list(m)) AS m FROM mn)")
    + "SELECT round(avg(utility), 6) AS mean, count(*) AS n, round(any_value(so.m[5]), 6) AS low, round(any_value(so.m[195]), 6) AS high FROM fb, so",
    "rating_sample": P.ctes(P.FB) + """SELECT id AS key, memory_id, utility FROM fb WHERE utility > 0
      ORDER BY round(ln((('0x' || substr(md5(concat_ws('|', id, 42)), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296) / utility, 9) DESC, id LIMIT 100""",
    # The greatest over starts of the least over ends of the mean between them; its steps, first and last score of each.
    "rating_isotonic": P.ctes(*_RBASE, "gr AS (SELECT round_even(score / 1e-4, 0) AS g, sum((utility >= 0.5)::INTEGER)::DOUBLE AS y, count(*)::DOUBLE AS w FROM ra GROUP BY 1)",
      "cu AS (SELECT g, sum(y) OVER o AS sy, sum(w) OVER o AS sw, y, w FROM gr WINDOW o AS (ORDER BY g))", "ab AS (SELECT j.g AS j, k.g AS k, (k.sy - j.sy + j.y) / (k.sw - j.sw + j.w) AS a FROM cu j JOIN cu k ON k.g >= j.g)",
      "mi AS (SELECT j, k AS i, min(a) OVER (PARTITION BY j ORDER BY k DESC) AS a FROM ab)", "iso AS (SELECT i, round(max(a), 9) AS rate FROM mi GROUP BY i)", "bl AS (SELECT rate, min(i) AS lo, max(i) AS hi FROM iso GROUP BY rate)")
    + "SELECT round(lo * 1e-4, 4) AS score, round(rate, 6) AS rate FROM bl UNION SELECT round(hi * 1e-4, 4), round(rate, 6) FROM bl",
}
