"""Retrieval quality: rankings (query, memory_id, rank from 1) held against relevance (query, memory_id, rel).

Metrics are per query unless said otherwise. Queries without relevant items are left out, as is said of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def judged(ranking: DataFrame, truth: DataFrame) -> DataFrame:
    """The ranking with rel (0 where unjudged), for queries that have a truth."""
    return ranking.join(truth.select("query").distinct(), "query", "left_semi").join(truth.select("query", "memory_id", "rel"), ["query", "memory_id"], "left").fillna(0.0, ["rel"])


def binary_metrics(ranking: DataFrame, truth: DataFrame, threshold: float = 0.5, ks: tuple[int, ...] = (1, 3, 5, 10, 20)) -> DataFrame:
    """query, mrr, hit_k for each k, ndcg10: an item is relevant from ``threshold`` on; queries without one are left out."""
    relevant = truth.where(F.col("rel") >= threshold)
    wanted = relevant.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    found = ranking.join(relevant.select("query", "memory_id"), ["query", "memory_id"], "left_semi").groupBy("query").agg(
        F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1.0))).alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    joined = wanted.join(found, "query", "left")
    return joined.select(
        "query",
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
        *[F.coalesce((F.col("first") <= k).cast("int"), F.lit(0)).alias(f"hit_{k}") for k in ks],
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg10"),
    )


def recall_at(ranking: DataFrame, truth: DataFrame, k: int = 10, threshold: float = 0.5) -> DataFrame:
    """One row: micro recall (all hits over all relevant items) and macro recall (mean over queries with any)."""
    relevant = truth.where(F.col("rel") >= threshold)
    hits = ranking.where(F.col("rank") <= k).join(relevant.select("query", "memory_id"), ["query", "memory_id"], "left_semi").groupBy("query").agg(F.count(F.lit(1)).alias("hits"))
    per = relevant.groupBy("query").agg(F.count(F.lit(1)).alias("n")).join(hits, "query", "left").fillna(0, ["hits"])
    return per.agg((F.sum("hits") / F.sum("n")).alias("micro"), F.avg(F.col("hits") / F.col("n")).alias("macro"), F.count(F.lit(1)).alias("queries"))


def shown(ranking: DataFrame, budget: int) -> DataFrame:
    """The prefix of each ranking, with its column tokens, up to the first item that overflows the budget."""
    order = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranking.withColumn("used", F.sum("tokens").over(order)).where(F.col("used") <= budget).drop("used")


def _discounted(position: Column) -> Column:
    return 1 / F.log2(position + 1.0)


def ndcg_by_length(ranking: DataFrame, truth: DataFrame, budget: int) -> DataFrame:
    """query, ndcg: gains of the shown prefix over those of as many of the best judged items, whatever their size.

    A query whose first item overflows scores 0.
    """
    seen = judged(shown(ranking, budget), truth).groupBy("query").agg(F.sum(F.col("rel") * _discounted(F.col("rank"))).alias("dcg"), F.count(F.lit(1)).alias("n"))
    best = truth.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("rel"), "memory_id")))
    ideal = best.join(seen.select("query", "n"), "query").where(F.col("at") <= F.col("n")).groupBy("query").agg(F.sum(F.col("rel") * _discounted(F.col("at"))).alias("idcg"))
    joined = truth.select("query").distinct().join(seen, "query", "left").join(ideal, "query", "left")
    return joined.select("query", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def ndcg_by_packing(ranking: DataFrame, truth: DataFrame, budget: int) -> DataFrame:
    """query, ndcg: as above, but the ideal takes the best judged items that still fit, skipping those that don't.

    ``truth`` has tokens. The greedy packing is a fold over a query's judged items in order of relevance, then id.
    """
    seen = judged(shown(ranking, budget), truth).groupBy("query").agg(F.sum(F.col("rel") * _discounted(F.col("rank"))).alias("dcg"))
    items = truth.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("rel")).alias("o"), "memory_id", F.col("tokens").cast("long").alias("tokens")))).alias("items"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.lit(0.0).alias("gain"))

    def take(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["tokens"] <= budget
        return F.when(fits, F.struct((acc["used"] + x["tokens"]).alias("used"), (acc["n"] + 1).alias("n"), (acc["gain"] - x["o"] * _discounted(acc["n"] + 1)).alias("gain"))).otherwise(acc)

    ideal = items.select("query", F.aggregate("items", start, take)["gain"].alias("idcg"))
    return ideal.join(seen, "query", "left").select("query", F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0).alias("ndcg"))


def graded_recall(ranking: DataFrame, truth: DataFrame, budget: int, threshold: float = 0.5) -> DataFrame:
    """One row: relevance among the shown relevant items over that of as many of the best, pooled over queries."""
    good = judged(shown(ranking, budget), truth).where(F.col("rel") >= threshold).groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.sum("rel").alias("got"))
    best = truth.withColumn("at", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("rel"), "memory_id")))
    ideal = best.join(good, "query").where(F.col("at") <= F.col("n")).groupBy("query").agg(F.sum("rel").alias("best"), F.first("got").alias("got"))
    return ideal.agg((F.sum("got") / F.sum("best")).alias("graded_recall"), F.count(F.lit(1)).alias("queries"))


def at_budgets(ranking: DataFrame, truth: DataFrame, budgets: tuple[int, ...], threshold: float = 0.5) -> DataFrame:
    """budget, miss_any, miss_best, mrr: share of queries whose shown prefix has no relevant item, or not the best one."""
    order = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    best = truth.groupBy("query").agg(F.min_by("memory_id", F.struct(-F.col("rel"), "memory_id")).alias("best"), F.max("rel").alias("top")).where(F.col("top") >= threshold)
    placed = judged(ranking.withColumn("used", F.sum("tokens").over(order)), truth).join(best, "query")
    first = placed.groupBy("query").agg(
        F.min(F.when(F.col("rel") >= threshold, F.struct("used", "rank"))).alias("any"), F.min(F.when(F.col("memory_id") == F.col("best"), F.col("used"))).alias("best_used")
    )
    per = best.select("query").join(first, "query", "left").withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    hit = F.coalesce(F.col("any.used") <= F.col("budget"), F.lit(False))
    return per.groupBy("budget").agg(
        F.avg((~hit).cast("double")).alias("miss_any"),
        F.avg((~F.coalesce(F.col("best_used") <= F.col("budget"), F.lit(False))).cast("double")).alias("miss_best"),
        F.avg(F.when(hit, 1.0 / F.col("any.rank")).otherwise(0.0)).alias("mrr"),
        F.count(F.lit(1)).alias("queries"),
    )


def value_ranks(df: DataFrame, value: str) -> DataFrame:
    """(value, n, avg_rank) over the whole table: counts per distinct value, then running totals of the counts.

    The totals run over ranges of values, then within each range, so that no single task sees all distinct values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranged = counts.repartitionByRange("v").withColumn("part", F.spark_partition_id())
    before = ranged.groupBy("part").agg(F.sum("n").alias("t")).withColumn("before", F.sum("t").over(Window.orderBy("part")) - F.col("t")).drop("t")
    upto = ranged.withColumn("upto", F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).join(F.broadcast(before), "part")
    return upto.select(F.col("v").alias(value), "n", (F.col("before") + F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0).alias("avg_rank"))


def correlation(x: str, y: str | Column) -> Column:
    """Pearson's correlation; null where a column doesn't vary."""
    y = F.col(y) if isinstance(y, str) else y
    return F.try_divide(F.covar_pop(F.col(x), y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, Pearson and Spearman correlation of two columns; null for fewer than three rows."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    ranked = rows.join(value_ranks(rows, x).select(x, F.col("avg_rank").alias("rx")), x).join(value_ranks(rows, y).select(y, F.col("avg_rank").alias("ry")), y)
    n = F.count(F.lit(1))
    return ranked.agg(n.alias("n"), F.when(n >= 3, correlation(x, y)).alias("pearson"), F.when(n >= 3, correlation("rx", "ry")).alias("spearman"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: area under the ROC curve by ranks with ties, and the point-biserial correlation; null without both classes."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(score, F.col(label).cast("boolean").alias("y"))
    ranked = rows.join(value_ranks(rows, score).select(score, "avg_rank"), score)
    pos, neg = F.sum(F.col("y").cast("long")), F.sum((~F.col("y")).cast("long"))
    got = ranked.agg(pos.alias("pos"), neg.alias("neg"), F.sum(F.when(F.col("y"), F.col("avg_rank"))).alias("ranks"), correlation(score, F.col("y").cast("double")).alias("point_biserial"))
    return got.select("pos", "neg", F.when((F.col("pos") > 0) & (F.col("neg") > 0), (F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2) / (F.col("pos") * F.col("neg").cast("double"))).alias("auc"), "point_biserial")


def threshold_sweep(df: DataFrame, score: str, label: str, beta: float = 2.0, steps: int = 50) -> DataFrame:
    """threshold, surfaced, precision, recall, f_beta for an even grid between the extreme scores.

    Each row counts once in the histogram cell below its score, so the sweep is a suffix sum over the grid's few cells.
    Precision is 1 when nothing is surfaced.
    """
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(score, F.col(label).cast("int").alias("y"))
    ends = rows.agg(F.min(score).alias("lo"), F.max(score).alias("hi"), F.sum("y").alias("positives"))
    grid = ends.select("positives", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * i / steps, 9))).alias("i", "threshold"))
    cells = rows.crossJoin(F.broadcast(grid.agg(F.sort_array(F.collect_list("threshold")).alias("grid")))).select(F.size(F.filter("grid", lambda t: t <= F.col(score))).alias("cell"), "y")  # one row
    counts = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("tp"))
    onward = grid.join(F.broadcast(counts), F.col("cell") > F.col("i"), "left").groupBy("i", "threshold", "positives").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("surfaced"), F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"))
    precision = F.when(F.col("surfaced") == 0, 1.0).otherwise(F.col("tp") / F.col("surfaced"))
    recall = F.when(F.col("positives") > 0, F.col("tp") / F.col("positives")).otherwise(0.0)
    scored = onward.withColumn("precision", precision).withColumn("recall", recall)
    b2 = beta * beta
    f = F.when(b2 * F.col("precision") + F.col("recall") > 0, (1 + b2) * F.col("precision") * F.col("recall") / (b2 * F.col("precision") + F.col("recall"))).otherwise(0.0)
    return scored.select("threshold", "surfaced", "precision", "recall", f.alias("f_beta"))


def token_f1(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """key, f1: F1 of two texts' words as multisets, after dropping punctuation and articles; 0 if either has none."""

    def clean(c: str) -> Column:
        bare = F.regexp_replace(F.lower(F.coalesce(F.col(c), F.lit(""))), r"[^\p{L}\p{N}\s]", "")
        return F.filter(F.split(bare, r"\s+"), lambda w: (w != "") & ~w.isin("a", "an", "the", "and"))

    sides = pairs.select("key", clean(left).alias("a"), clean(right).alias("b"))
    counted = lambda c, n: sides.select("key", F.explode(c).alias("w")).groupBy("key", "w").agg(F.count(F.lit(1)).alias(n))
    common = counted("a", "na").join(counted("b", "nb"), ["key", "w"]).groupBy("key").agg(F.sum(F.least("na", "nb")).alias("common"))
    total = F.size("a") + F.size("b")
    return sides.join(common, "key", "left").select("key", F.when((F.size("a") == 0) | (F.size("b") == 0), 0.0).otherwise(2.0 * F.coalesce("common", F.lit(0)) / total).alias("f1"))


def cliff(ranking: DataFrame, least: int = 5, z: float = 2.0, floor: float = 0.005) -> DataFrame:
    """query, cut: how many results stand before the score drops off.

    For each place from ``least`` + 1 on, the line of score on log rank is fitted to the places before it; the first
    place that lies more than z times the fit's root mean square error (at least ``floor``) below the line is the cliff.
    Scores are divided by the query's best. Without a cliff all stand.
    """
    top = F.max("score").over(Window.partitionBy("query"))
    rows = ranking.withColumn("y", F.when(top > 0, F.col("score") / top).otherwise(0.0)).withColumn("x", F.log(F.col("rank").cast("double")))
    past = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    fitted = rows.select(
        "query", "rank", "x", "y", F.count("y").over(past).alias("n"), F.regr_slope("y", "x").over(past).alias("b"), F.regr_intercept("y", "x").over(past).alias("a"),
        F.regr_syy("y", "x").over(past).alias("syy"), F.regr_sxy("y", "x").over(past).alias("sxy"),
    )
    error = F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - F.col("b") * F.col("sxy")) / F.col("n"))
    falls = (F.col("n") >= least) & (F.col("a") + F.col("b") * F.col("x") - F.col("y") > z * F.greatest(error, F.lit(floor)))
    return fitted.groupBy("query").agg(F.coalesce(F.min(F.when(falls, F.col("rank") - 1)), F.max("rank")).cast("int").alias("cut"))


#: Fixed value: cumulated chances of 0, 1, 2, .. of a Poisson number of mean 1, as counts of 65,536.
POISSON = (24109, 48219, 60273, 64292, 65296, 65497, 65531, 65535)


def bootstrap_mean(df: DataFrame, value: str, replicates: int = 200, seed: int = 1729) -> DataFrame:
    """One row: mean of a column with the 2.5 and 97.5 percentile of resampled means.

    Each row draws a Poisson(1) count per replicate from a hash of its key, which stands for sampling with replacement at any
    size; one hash serves eight replicates, and per replicate only two sums are kept. ``df`` has a unique column key.
    """
    chunks = df.where(F.col(value).isNotNull()).select("key", F.col(value).alias("v"), F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 8))).alias("c"))
    hashed = chunks.select("v", "c", F.md5(F.concat_ws("|", F.col("key").cast("string"), F.col("c").cast("string"), F.lit(str(seed))).cast("binary")).alias("h"))
    drawn = hashed.select("v", "h", "c", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")).select("v", (F.col("c") * 8 + F.col("i")).alias("b"), F.conv(F.substr("h", F.col("i") * 4 + 1, F.lit(4)), 16, 10).cast("int").alias("u"))
    weight = sum(((F.col("u") >= s).cast("int") for s in POISSON), F.lit(0))
    means = drawn.where(F.col("b") < replicates).withColumn("w", weight).groupBy("b").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("m"))
    ends = means.agg(F.sort_array(F.collect_list("m")).alias("m"))  # one number a replicate
    at = lambda q: F.element_at("m", F.lit(int(q * (replicates - 1)) + 1))
    return df.agg(F.avg(value).alias("mean"), F.count(value).alias("n")).crossJoin(ends).select("mean", "n", at(0.025).alias("low"), at(0.975).alias("high"))


def weighted_sample(df: DataFrame, weight: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement with chances by weight: the largest u^(1/w), u being a hash of the unique column key."""
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.col("key").cast("string"), F.lit(str(seed))).cast("binary")), 1, 8), 16, 10).cast("long") + 0.5) / float(1 << 32)
    return df.where(F.col(weight) > 0).withColumn("draw", F.round(F.log(u) / F.col(weight), 9)).orderBy(F.desc("draw"), "key").limit(n).drop("draw")


def isotonic(df: DataFrame, score: str, label: str, grid: float = 1e-4) -> DataFrame:
    """(score, rate): the non-decreasing step function of a score that fits a 0/1 label best, at its corners.

    Scores are rounded to the ``grid`` first, which bounds the model that the driver holds by the range of scores. Pools of violators are merged within partitions first, then across them, by Spark's own isotonic regression.
    """
    from pyspark.ml.regression import IsotonicRegression

    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy((F.rint(F.col(score) / grid) * grid).alias("features")).agg(F.avg(F.col(label).cast("double")).alias("label"), F.count(F.lit(1)).cast("double").alias("weight"))
    if rows.isEmpty():
        return df.sparkSession.createDataFrame([], "score double, rate double")
    model = IsotonicRegression(weightCol="weight").fit(rows)
    pairs = [(float(b), float(p)) for b, p in zip(model.boundaries, model.predictions)]  # the model itself, one pair a corner
    return df.sparkSession.createDataFrame(pairs, "score double, rate double")
