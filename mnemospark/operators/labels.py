"""Labels, samples and comparisons for rankers: gains, levels, negatives, misses by budget, gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Token budgets of the miss curve, each twice the one before.
MISS_BUDGETS = (250, 500, 1000, 2000, 4000, 8000)
#: Upper edges of the gap histogram; the last bucket is open.
GAP_EDGES = (0, 10, 25, 50, 100, 250, 1000)


def weighted_miss(ranking: DataFrame, relevant: DataFrame, utility: DataFrame, budgets: tuple[int, ...] = MISS_BUDGETS, least: float = 0.1, power: float = 1.5) -> DataFrame:
    """(budget, miss): share of the weight of relevant memories that a budget doesn't show, and its mean over the budgets, under budget 0.

    A memory weighs its mean utility to the ``power``; those of ``least`` or lower don't count. ``relevant`` is (query,
    memory_id) and ``utility`` (memory_id, mean). Without any weight the miss is 0.
    """
    weighed = relevant.join(utility.where(F.col("mean") > least), "memory_id").select("query", "memory_id", F.pow("mean", F.lit(power)).alias("w"))
    order = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    used = ranking.withColumn("used", F.sum("tokens").over(order)).select("query", "memory_id", "used")
    found = weighed.join(used, ["query", "memory_id"], "left")
    lost = [F.coalesce(F.sum(F.when(F.col("used").isNull() | (F.col("used") > b), F.col("w"))) / F.sum("w"), F.lit(0.0)).alias(str(b)) for b in budgets]
    one = found.agg(*lost)
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(b).alias("budget"), F.col(str(b)).alias("miss")) for b in budgets], F.struct(F.lit(0).alias("budget"), (sum((F.col(str(b)) for b in budgets), F.lit(0.0)) / len(budgets)).alias("miss")))).alias("r"))
    return rows.select("r.budget", "r.miss")


def discovery(ranking: DataFrame, truth: DataFrame, threshold: float = 0.7) -> DataFrame:
    """One row: how many highly relevant (query, memory_id) there are and how many the rankings list anywhere."""
    high = truth.where(F.col("rel") >= threshold).select("query", "memory_id")
    found = high.join(ranking.select("query", "memory_id").withColumn("found", F.lit(1)), ["query", "memory_id"], "left")
    return found.agg(F.count(F.lit(1)).alias("high"), F.count("found").alias("found")).withColumn("rate", F.when(F.col("high") > 0, F.col("found") / F.col("high")).otherwise(0.0))


def compared(before: DataFrame, after: DataFrame, value: str = "ndcg", tie: float = 1e-6) -> DataFrame:
    """(query, before, after, delta, outcome) of two metrics per query; a query that one of them lacks is left out."""
    both = before.select("query", F.col(value).alias("before")).join(after.select("query", F.col(value).alias("after")), "query")
    delta = F.col("after") - F.col("before")
    return both.withColumn("delta", delta).withColumn("outcome", F.when(delta > tie, "win").when(delta < -tie, "loss").otherwise("tie"))


def rank_gaps(ranking: DataFrame, truth: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(bucket, cases): by how many places highly relevant memories are ranked lower than the judged order would have them."""
    ideal = truth.withColumn("ideal", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("rel"), "memory_id"))).where(F.col("rel") >= threshold)
    gaps = ideal.join(ranking.select("query", "memory_id", "rank"), ["query", "memory_id"]).select((F.col("rank") - F.col("ideal")).alias("gap")).where("gap > 0")
    bucket = sum((F.when(F.col("gap") > e, 1).otherwise(0) for e in GAP_EDGES), F.lit(0)) - 1
    return gaps.groupBy(bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("cases"))


def label_levels(truth: DataFrame, levels: int = 10) -> DataFrame:
    """``truth`` (query, memory_id, rel) with a whole number as its level: 0 for no relevance, else the quantile bin of the positives.

    From 100 levels on a level is the rounded multiple, at least 1. Equal edges fall together, so there may be fewer levels.
    """
    if levels >= 100:
        return truth.withColumn("level", F.when(F.col("rel") > 0, F.greatest(F.lit(1), F.least(F.lit(levels), F.rint(F.col("rel") * levels).cast("int")))).otherwise(0))
    shares = [i / (levels - 1) for i in range(levels)]
    edges = truth.where("rel > 0").agg(F.expr(f"array_distinct(percentile(rel, array({', '.join(map(repr, shares))})))").alias("edges"))
    below = F.expr("size(filter(slice(edges, 1, greatest(size(edges) - 1, 0)), e -> e <= rel))")
    return truth.crossJoin(F.broadcast(edges)).withColumn("level", F.when(F.col("rel") > 0, below).otherwise(0).cast("int")).drop("edges")  # one row


def label_gains(labelled: DataFrame) -> DataFrame:
    """(level, gain, rows): mean relevance of each level."""
    return labelled.groupBy("level").agg(F.avg("rel").alias("gain"), F.count(F.lit(1)).alias("rows"))


def training_rows(ranking: DataFrame, truth: DataFrame, ratio: int = 3, top: int = 20) -> DataFrame:
    """(query, memory_id, rel, negative): judged candidates, and for each query up to ``ratio`` times as many unjudged ones of its first ``top``.

    Which ones is a repeatable draw by hash. Queries without judged candidates are left out; labels under 0.1 are 0.
    """
    rows = ranking.join(truth.select("query", "memory_id", "rel"), ["query", "memory_id"], "left")
    judged = rows.where("rel is not null")
    count = judged.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    draw = F.md5(F.concat_ws("|", "query", "memory_id").cast("binary"))
    drawn = rows.where(F.col("rel").isNull() & (F.col("rank") <= top)).withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(draw, "memory_id")))
    negatives = drawn.join(count, "query").where(F.col("at") <= ratio * F.col("n"))
    label = F.when(F.col("rel") < 0.1, 0.0).otherwise(F.col("rel"))
    return judged.select("query", "memory_id", label.alias("rel"), F.lit(False).alias("negative")).unionByName(negatives.select("query", "memory_id", F.lit(0.0).alias("rel"), F.lit(True).alias("negative")))


def above_floor(ranking: DataFrame, ratio: float = 0.5) -> DataFrame:
    """The rows of each ranking whose score is at least that share of its best score."""
    best = F.max("score").over(Window.partitionBy("query"))
    return ranking.withColumn("__best", best).where(F.col("score") >= F.col("__best") * ratio).drop("__best")


def cutoffs(shown_scores: DataFrame, useful: DataFrame) -> DataFrame:
    """Per recall: where its usefulness ends, and how clear the end is.

    ``shown_scores`` is (recall_id, rank from 1, score), ``useful`` (recall_id, rank) of the results found useful. cutoff_rank is the
    rank of the last useful one. gap is its score less that of the next; ratios are shares of the top score. Recalls without a useful result are left out.
    """
    last = useful.groupBy("recall_id").agg(F.max("rank").alias("cutoff_rank"))
    rows = shown_scores.join(last, "recall_id")
    per = rows.groupBy("recall_id").agg(
        F.max("cutoff_rank").alias("cutoff_rank"), F.count(F.lit(1)).alias("total_returned"), F.max("score").alias("top_score"),
        F.max(F.when(F.col("rank") == F.col("cutoff_rank"), F.col("score"))).alias("last_useful_score"), F.max(F.when(F.col("rank") == F.col("cutoff_rank") + 1, F.col("score"))).alias("first_noise_score"),
    )
    gap = F.col("last_useful_score") - F.col("first_noise_score")
    share = lambda c: F.when(F.col("top_score") > 0, c / F.col("top_score")).otherwise(0.0)
    return per.withColumn("cutoff_ratio", share(F.col("last_useful_score"))).withColumn("gap", gap).withColumn("gap_ratio", F.when(gap.isNotNull(), share(gap)))


