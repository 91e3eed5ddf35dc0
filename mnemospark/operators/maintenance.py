"""Maintenance of the store: statistics, decay, retention, themes, topics, near-duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.config import MAINTENANCE, Maintenance
from mnemospark.functions.scores import days_between, effective_priority
from mnemospark.functions.text import normal_themes
from mnemospark.operators.folds import running_fold

ACTIVE = "status = 'active'"


def latest_time(events: DataFrame) -> DataFrame:
    """One row (now): the time of the newest event, which stands for the present."""
    return events.agg(F.max("created_at").alias("now"))


def overview(memories: DataFrame, now: DataFrame) -> DataFrame:
    """One row of counts over the active memories: tokens, access, decay, confidence, age."""
    active = memories.where(ACTIVE).crossJoin(F.broadcast(now))  # one row
    low = effective_priority(F.col("base_priority"), F.col("last_accessed"), F.col("decay_rate"), F.col("category"), F.col("flags"), F.col("now")) < F.col("base_priority") * 0.5
    return active.agg(
        F.count(F.lit(1)).alias("active"),
        F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"),
        F.count_if((F.col("recall_count") == 0) & (F.col("reflect_count") == 0)).alias("never_accessed"),
        F.count_if(days_between(F.col("now"), F.col("last_accessed")) < 7).alias("recently_accessed"),
        F.count_if(low).alias("near_floor"),
        F.count("decay_rate").alias("own_decay_rate"),
        F.avg("confidence").alias("mean_confidence"),
        F.count_if(F.col("confidence") < 0.4).alias("low_confidence"),
        F.count_if(F.col("confidence") > 0.8).alias("high_confidence"),
        F.count_if(F.col("last_sleep_processed").isNull()).alias("unprocessed"),
        F.min("created_at").alias("oldest"),
        F.max("created_at").alias("newest"),
    )


def prefix_table(memories: DataFrame, length: int = 8) -> DataFrame:
    """(prefix, id): id prefixes that belong to one memory only; ambiguous ones resolve to nothing."""
    ids = memories.where("id is not null").select("id").distinct()
    return ids.groupBy(F.substring("id", 1, length).alias("prefix")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def retention(events: DataFrame, now: DataFrame, params: Maintenance = MAINTENANCE) -> tuple[DataFrame, DataFrame]:
    """(kept, archived): retrieved events beyond the archive age go to the archive, each id once; all else stays."""
    marked = events.where("id is not null").crossJoin(F.broadcast(now))
    old = (F.col("event_type") == "retrieved") & F.coalesce(days_between(F.col("now"), F.col("created_at")) > params.archive_days, F.lit(False))
    rows = marked.withColumn("old", F.coalesce(old, F.lit(False))).drop("now").dropDuplicates(["id"])
    return rows.where("not old").drop("old"), rows.where("old").drop("old")


def theme_counts(memories: DataFrame) -> DataFrame:
    """(theme, memories) over the memories' normal themes."""
    return memories.select("id", F.explode(normal_themes(F.col("themes"))).alias("theme")).groupBy("theme").agg(F.count(F.lit(1)).alias("memories"))


def theme_variants(counts: DataFrame) -> DataFrame:
    """(variant, theme, reason, n_variant, n_theme): themes that differ from a more frequent one in form only.

    Forms are compared by equality on keys (case and separators dropped, plural s, -ing), so no pair of themes is
    formed that doesn't match. Of a key's themes the most frequent is the form to keep, ties by alphabet.
    """
    bare = F.regexp_replace(F.lower("theme"), r"[-_\s]", "")
    stem = F.regexp_replace(bare, "(?:s|ing)$", "")
    keyed = counts.select("theme", "memories", bare.alias("bare"), stem.alias("stem"))

    def by(key: str, reason: str) -> DataFrame:
        best = keyed.groupBy(key).agg(F.min_by(F.struct("theme", "memories", "bare"), F.struct(-F.col("memories"), "theme")).alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = keyed.join(best, key).where("theme <> best.theme")
        rows = rows if key == "bare" else rows.where("bare <> best.bare")
        return rows.select(F.col("theme").alias("variant"), F.col("best.theme").alias("theme"), F.lit(reason).alias("reason"), F.col("memories").alias("n_variant"), F.col("best.memories").alias("n_theme"))

    return by("bare", "form").unionByName(by("stem", "ending"))


def similarity_histogram(events: DataFrame, width: float = 0.05) -> DataFrame:
    """(bucket, one column per kind): events by similarity score in even buckets; bucket null where there is no score."""
    bucket = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("similarity_score"))) / width + 1e-9).cast("int")
    kind = F.when(F.size(F.coalesce("co_memory_ids", F.array())) == 0, "alone").when(F.size("co_memory_ids") <= 4, "few").otherwise("many")
    return events.select(bucket.alias("bucket"), kind.alias("kind")).groupBy("bucket").pivot("kind", ["alone", "few", "many"]).agg(F.count(F.lit(1))).fillna(0, ["alone", "few", "many"])


def topic_health(memories: DataFrame, now: DataFrame) -> DataFrame:
    """Per topic: details, summaries, how stale and how vital it is, and whether it lacks a summary.

    Vitality is the sum of exp(-0.05 * days) over active details. A topic is stale once the details newer than its newest
    summary number at least two, and a fifth of all. A gap is a topic of five details or more without a summary.
    """
    active = memories.where(ACTIVE).where("topic_id is not null").crossJoin(F.broadcast(now))
    newest = active.where("layer <> 'detail'").groupBy("topic_id").agg(F.max("created_at").alias("summarised"), F.count(F.lit(1)).alias("summaries"))
    details = active.where("layer = 'detail'").join(newest, "topic_id", "left")
    per = details.groupBy("topic_id").agg(
        F.count(F.lit(1)).alias("details"),
        F.coalesce(F.max("summaries"), F.lit(0)).alias("summaries"),
        F.count_if(F.col("summarised").isNull() | (F.col("created_at") > F.col("summarised"))).alias("new_details"),
        F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"),
        F.sum(F.exp(-0.05 * F.greatest(F.lit(0.0), days_between(F.col("now"), F.col("created_at"))))).alias("vitality"),
    )
    stale = F.col("new_details") >= F.greatest(F.lit(2.0), F.ceil(F.col("details") * 0.2))
    return per.withColumn("stale", stale).withColumn("gap", (F.col("details") >= 5) & (F.col("summaries") == 0))


def health(memories: DataFrame, topics: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row: shares of shadowed memories, stale topics and silent topics, and the risk they add up to."""
    active = memories.where(ACTIVE)
    shadowed = active.agg(F.avg((F.coalesce("shadow_load", F.lit(0.0)) > 0.5).cast("double")).alias("shadowed"))
    stale = topics.agg(F.avg(F.col("stale").cast("double")).alias("stale"))
    heard = active.where("topic_id is not null").select("topic_id", F.col("id").alias("memory_id")).join(feedback.select("memory_id").distinct(), "memory_id", "left_semi").select("topic_id").distinct()
    silent = topics.join(heard.withColumn("heard", F.lit(1)), "topic_id", "left").agg(F.avg(F.col("heard").isNull().cast("double")).alias("silent"))
    return shadowed.crossJoin(stale).crossJoin(silent).withColumn("risk", 0.4 * F.col("shadowed") + 0.3 * F.col("stale") + 0.3 * F.col("silent"))  # one row each


def token_batches(rows: DataFrame, group: str, order: list[str], budget: int) -> DataFrame:
    """``rows`` with a batch number per group: a new batch starts where the next item would overflow the budget.

    The reset makes it a fold in order: rows stream by sorted by group, and only the running batch is held.
    """

    def step(state: tuple, row: dict) -> tuple:
        used, batch = state
        over = used > 0 and used + row["tokens"] > budget
        return (row["tokens"], batch + 1) if over else (used + row["tokens"], batch)

    kinds = dict(rows.dtypes)
    sized = rows.select(group, *order, F.col("tokens").cast("long").alias("tokens"))
    return running_fold(sized, [group], order, lambda row: (0, 0), step, lambda state: {"batch": state[1]}, f"{group} {kinds[group]}, " + ", ".join(f"{c} {kinds[c]}" for c in order) + ", tokens long, batch int")


def theme_quality(memories: DataFrame, feedback: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(theme, memories, quality, underserved): mean quality of a theme's active memories.

    A memory's quality is its mean utility, 0.1 if it was only ever retrieved, and 0 if not even that.
    """
    exact = lambda c: F.sum(c.cast("decimal(18,9)")).cast("double") / F.count(F.lit(1))  # noqa: E731  sums that don't hang on the order of rows
    rated = feedback.groupBy("memory_id").agg(exact(F.col("utility")).alias("mean"))
    seen = retrieved.select("memory_id").distinct().withColumn("seen", F.lit(True))
    per = memories.where(ACTIVE).select(F.col("id").alias("memory_id"), normal_themes(F.col("themes")).alias("themes")).join(rated, "memory_id", "left").join(seen, "memory_id", "left")
    quality = F.coalesce("mean", F.when(F.col("seen"), 0.1).otherwise(0.0))
    by_theme = per.select(F.explode("themes").alias("theme"), quality.alias("q")).groupBy("theme").agg(F.count(F.lit(1)).alias("memories"), exact(F.col("q")).alias("quality"))
    return by_theme.withColumn("underserved", F.col("quality") < 0.5)


def newest_per_topic(memories: DataFrame, n: int = 2) -> DataFrame:
    """The n newest deleted memories of each topic (what is kept of a superseded chain), with their place from 1."""
    order = Window.partitionBy("topic_id").orderBy(F.desc("created_at"), "id")
    return memories.where("status = 'deleted' and topic_id is not null").withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def near_duplicates(cosines: DataFrame, memories: DataFrame, most: float = 0.15) -> DataFrame:
    """(loser, winner, distance): active pairs (low, high, cosine) of one category within the distance; higher priority wins.

    Ties go to the smaller id. Of several winners over one memory the nearest counts. Equal vectors are pairs, too.
    """
    live = memories.where(ACTIVE).select("id", "category", "base_priority")
    a = live.select(F.col("id").alias("low"), F.col("category"), F.col("base_priority").alias("pa"))
    b = live.select(F.col("id").alias("high"), "category", F.col("base_priority").alias("pb"))
    close = cosines.withColumn("distance", F.round(1 - F.col("cosine"), 6)).where(F.col("distance") <= most)
    both = close.join(a, "low").join(b, ["high", "category"])
    second = F.coalesce("pb", F.lit(0)) > F.coalesce("pa", F.lit(0))
    sided = both.select(F.when(second, F.col("low")).otherwise(F.col("high")).alias("loser"), F.when(second, F.col("high")).otherwise(F.col("low")).alias("winner"), "distance")
    return sided.groupBy("loser").agg(F.min(F.struct("distance", "winner")).alias("m")).select("loser", "m.winner", "m.distance")


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, before, after, delta): counts per value of a column in two tables; a value that one lacks counts 0 there."""
    counted = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    both = counted(before, "before").join(counted(after, "after"), key, "full_outer").fillna(0, ["before", "after"])
    return both.withColumn("delta", F.col("after") - F.col("before"))
