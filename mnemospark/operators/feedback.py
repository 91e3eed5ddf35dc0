"""Feedback statistics: smoothed utility, priors, timing, and the matching of ratings to recalls."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.config import MAINTENANCE, SCORING, Maintenance, Scoring
from mnemospark.functions.scores import days_between, micros, seconds_between
from mnemospark.operators.folds import last_fold


def utilities(events: DataFrame) -> DataFrame:
    """(id, memory_id, session_id, created_at, utility) of the distinct feedback events.

    A missing or malformed utility counts as 0; utilities are clamped to 0..1. Events without an id or memory are dropped.
    """
    value = F.coalesce(F.get_json_object("context", "$.utility").try_cast("double"), F.lit(0.0))
    rows = events.where("event_type = 'feedback' and id is not null and memory_id is not null")
    return rows.select("id", "memory_id", "session_id", "created_at", F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("utility")).dropDuplicates(["id"])


#: Newest ratings that the smoothed mean is made of: with the weight at hand those before them add less than 1e-30 to it.
NEWEST = 128


def feedback_summary(feedback: DataFrame, now: Column, params: Scoring = SCORING) -> DataFrame:
    """Per memory: number of ratings, last and mean utility, smoothed utility and the mean weighted by age.

    Ratings are ordered by time, then id; those without a time come first. The smoothed mean is a sum: the i-th newest
    rating weighs a * (1 - a)^i, the very first (1 - a)^i. Ratings beyond the newest ``NEWEST`` weigh less than a double can
    tell, so each map task sends on no more than these, however hot a memory is. Counts and means are of all ratings.
    """
    age = F.exp(-0.01 * days_between(now, F.col("created_at")))
    totals = feedback.groupBy("memory_id").agg(
        F.count(F.lit(1)).alias("fb_count"),
        F.avg("utility").alias("fb_mean"),
        (F.sum(age * F.col("utility")) / F.sum(F.when(F.col("created_at").isNotNull(), age))).alias("fb_time_weighted"),
    )
    newest = Window.partitionBy("memory_id").orderBy(F.desc_nulls_last("created_at"), F.desc("id"))
    late = feedback.select("memory_id", "created_at", "id", "utility").withColumn("at", F.row_number().over(newest)).where(F.col("at") <= NEWEST)
    fade = F.pow(F.lit(1 - params.ewma_alpha), F.col("at") - 1)
    weight = F.when(F.col("at") == F.col("fb_count"), fade).otherwise(params.ewma_alpha * fade)
    smooth = late.join(totals.select("memory_id", "fb_count"), "memory_id").groupBy("memory_id").agg(F.max(F.when(F.col("at") == 1, F.col("utility"))).alias("fb_last"), F.sum(weight * F.col("utility")).alias("fb_ewma"))
    return totals.join(smooth, "memory_id").select("memory_id", "fb_count", "fb_mean", "fb_last", "fb_ewma", "fb_time_weighted")


def beta_prior(feedback: DataFrame, params: Scoring = SCORING) -> DataFrame:
    """One row (prior_mean, prior_strength): a Beta distribution fitted to memories' mean utilities by moments.

    Memories with two ratings or more are fitted. With fewer than five such memories the mean of all ratings is used, and
    the fallback strength; so it is where the variance fits no Beta distribution. Without ratings both fall back.
    """
    per = feedback.groupBy("memory_id").agg(F.avg("utility").alias("m"), F.count(F.lit(1)).alias("n"))
    fitted = per.where("n >= 2").agg(F.count(F.lit(1)).alias("memories"), F.avg("m").alias("mu"), F.var_pop("m").alias("var"))
    overall = feedback.agg(F.avg("utility").alias("mean"))
    few = F.col("memories") < params.prior_least_memories
    fits = (F.col("var") > 0) & (F.col("var") < F.col("mu") * (1 - F.col("mu")))
    return fitted.crossJoin(overall).select(  # one row each
        F.when(few, F.coalesce("mean", F.lit(params.prior_mean))).otherwise(F.col("mu")).alias("prior_mean"),
        F.when(~few & fits, F.col("mu") * (1 - F.col("mu")) / F.col("var") - 1).otherwise(params.prior_strength).alias("prior_strength"),
    )


def half_up(x: float, places: int) -> float:
    """Rounded as Spark rounds: by the decimal digits that a number is written with, halves away from zero."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP))


def confidence_after(feedback: DataFrame, start: DataFrame, params: Maintenance = MAINTENANCE) -> DataFrame:
    """(memory_id, confidence_before, confidence_after): ratings applied one after the other.

    A useful rating closes part of the gap to 1, a useless one takes off a share; each step is clamped and rounded to four
    places. ``start`` gives (memory_id, confidence), null meaning the default; ratings of unknown memories are dropped.
    """
    known = start.select("memory_id", F.coalesce("confidence", F.lit(params.confidence_start)).alias("confidence_before"))
    rows = feedback.select("memory_id", "created_at", "id", "utility").join(known, "memory_id")

    def step(c: float, row: dict) -> float:
        u = row["utility"]
        grown = c + params.growth * u * (1 - c) if u >= params.useful else c * (1 - params.shrink) if u < params.useless else c
        clamped = max(params.confidence_low, min(params.confidence_high, grown))
        return half_up(clamped, 4) if abs(clamped - c) > 0.001 else c

    made = lambda first, c: {"memory_id": first["memory_id"], "confidence_before": first["confidence_before"], "confidence_after": c}
    return last_fold(rows, ["memory_id"], ["created_at", "id"], lambda row: row["confidence_before"], step, made, "memory_id string, confidence_before double, confidence_after double")


def burstiness(events: DataFrame) -> DataFrame:
    """(memory_id, events, burstiness): variance over squared mean of the gaps between a memory's events, less 1.

    0 for fewer than three events or no gap at all. Gaps are in seconds; events without a time are left out.
    """
    timed = events.where("created_at is not null and memory_id is not null")
    order = Window.partitionBy("memory_id").orderBy("created_at", "id")
    gaps = timed.select("memory_id", seconds_between(F.col("created_at"), F.lag("created_at").over(order)).alias("gap"))
    per = gaps.groupBy("memory_id").agg(F.count(F.lit(1)).alias("events"), F.avg("gap").alias("mean"), F.var_pop("gap").alias("var"))
    value = F.when((F.col("events") < 3) | (F.col("mean") <= 0), 0.0).otherwise(F.col("var") / (F.col("mean") * F.col("mean")) - 1)
    return per.select("memory_id", "events", value.alias("burstiness"))


def match_recalls(feedback: DataFrame, recalls: DataFrame, within: int = 60) -> DataFrame:
    """Each rating with the nearest recall of its session, before or after, at most ``within`` seconds away.

    Result: feedback_id, memory_id, utility, recall_id, query, gap (seconds). Of two recalls at equal distance the later one is
    taken, then the one of the larger id. Sessions may hold any share of all rows: time is cut into stretches of ``within`` seconds, and
    a rating meets the recalls of its own stretch and the two next to it only. Rows without session or time match nothing.
    """
    stretch = F.floor(micros(F.col("created_at")) / F.lit(within * 1_000_000)).cast("long")
    left = (
        feedback.where("session_id is not null and created_at is not null")
        .select(F.col("id").alias("feedback_id"), "memory_id", "utility", "session_id", F.col("created_at").alias("rated_at"), F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("stretch"))
    )
    right = recalls.where("session_id is not null and created_at is not null").select(F.col("id").alias("recall_id"), "query", "session_id", F.col("created_at").alias("recalled_at"), stretch.alias("stretch"))
    gap = F.abs(micros(F.col("rated_at")) - micros(F.col("recalled_at")))
    near = left.join(right, ["session_id", "stretch"]).withColumn("gap", gap).where(F.col("gap") <= within * 1_000_000)
    best = near.groupBy("feedback_id").agg(F.min_by(F.struct("memory_id", "utility", "recall_id", "query", "gap"), F.struct("gap", -micros(F.col("recalled_at")), -F.col("recall_id"))).alias("b"))
    return best.select("feedback_id", "b.memory_id", "b.utility", "b.recall_id", "b.query", (F.col("b.gap") / 1e6).alias("gap"))


def match_shown(retrieved: DataFrame, recalls: DataFrame, within: int = 60) -> DataFrame:
    """(event_id, memory_id, score, recall_id): each returned memory with the recall that returned it.

    A recall writes its results first: it is the earliest one of the same session and query at or after the event, at most
    ``within`` seconds later; ties go to the smaller id. Sessions of any size are met by stretches of time. Rows
    without session, query or time belong to no recall.
    """
    stretch = F.floor(micros(F.col("created_at")) / F.lit(within * 1_000_000)).cast("long")
    whole = "session_id is not null and query is not null and created_at is not null"
    left = retrieved.where(whole).select(F.col("id").alias("event_id"), "memory_id", F.col("similarity_score").alias("score"), "session_id", "query", micros(F.col("created_at")).alias("shown"), F.explode(F.array(stretch, stretch + 1)).alias("stretch"))
    right = recalls.where(whole).select(F.col("id").alias("recall_id"), "session_id", "query", micros(F.col("created_at")).alias("written"), stretch.alias("stretch"))
    near = left.join(right, ["session_id", "query", "stretch"]).where((F.col("written") >= F.col("shown")) & (F.col("written") - F.col("shown") <= within * 1_000_000))
    best = near.groupBy("event_id").agg(F.min_by(F.struct("memory_id", "score", "recall_id"), F.struct("written", "recall_id")).alias("b"))
    return best.select("event_id", "b.memory_id", "b.score", "b.recall_id")


def ground_truth(matched: DataFrame, least_memories: int = 3) -> DataFrame:
    """(query, memory_id, rel, ratings): mean utility of a memory for a query, for queries with enough rated memories."""
    rel = matched.where("query is not null").groupBy("query", "memory_id").agg(F.avg("utility").alias("rel"), F.count(F.lit(1)).alias("ratings"))
    enough = rel.groupBy("query").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_memories)
    return rel.join(enough.select("query"), "query", "left_semi")


def edge_weights_after(edges: DataFrame, feedback: DataFrame, params: Maintenance = MAINTENANCE) -> DataFrame:
    """(id, weight_before, weight_after): a link gains with each useful rating of an end and loses with each other one.

    Steps are clamped to 0..1 one by one, in order of time. Links whose ends nobody rated are left out. Repeated links
    of one id count once; a missing weight is 0.5.
    """
    one = edges.where("id is not null").dropDuplicates(["id"]).select("id", "source_id", "target_id", F.coalesce("weight", F.lit(0.5)).alias("weight"))
    ends = one.select("id", "weight", F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("memory_id")).where("memory_id is not null")
    rated = ends.join(feedback.select("memory_id", "created_at", F.col("id").alias("event"), "utility"), "memory_id")
    step = lambda w, row: max(0.0, min(1.0, w + (params.edge_up if row["utility"] >= params.useful else -params.edge_down)))
    made = lambda first, w: {"id": first["id"], "weight_before": first["weight"], "weight_after": w}
    kinds = dict(rated.dtypes)
    return last_fold(rated.select("id", "weight", "created_at", "event", "utility"), ["id"], ["created_at", "event"], lambda row: row["weight"], step, made, f"id {kinds['id']}, weight_before double, weight_after double")
