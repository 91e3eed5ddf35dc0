"""Upkeep by rules: decay rates after signals of durability, dormancy, stubs, mapped themes, expressions of time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.config import MAINTENANCE, Maintenance
from mnemospark.functions.scores import days_between, decay_rate
from mnemospark.functions.text import normal_themes
from mnemospark.operators.folds import last_fold

# Expressions of time as they count for ranking; single words and phrases, in any letter case.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
TIME_EXPRESSION = rf"(?i)\b(?:(?:{MONTHS})\b|20\d{{2}}|yesterday|today|tomorrow|(?:last|next|this)\s+(?:week|month|year|summer|winter|spring|fall)|\d{{1,2}}/\d{{1,2}}(?:/\d{{2,4}})?|\d{{1,2}}\s+(?:days?|weeks?|months?|years?)\s+ago)"
# Themes that stand for another one, and phrases of a content that imply a theme.
THEME_VARIANTS = {"recall_feedback": "recall-feedback", "startup_load": "startup-load", "decisions": "decision"}
CONTENT_PHRASES = {"memory system": "memory-system", "sleep pipeline": "sleep-pipeline"}


def time_expressions(text: Column) -> Column:
    """How many dates, years and relative times a text names; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TIME_EXPRESSION)), F.lit(0))


def durabilities(events: DataFrame) -> DataFrame:
    """(id, memory_id, created_at, durability) of the distinct feedback events that carry a signal of more than a hundredth."""
    value = F.get_json_object("context", "$.durability").try_cast("double")
    rows = events.where("event_type = 'feedback' and id is not null and memory_id is not null").select("id", "memory_id", "created_at", value.alias("durability"))
    return rows.where(F.abs("durability") > 0.01).dropDuplicates(["id"])


def decay_after(signals: DataFrame, memories: DataFrame, scale: float = 0.2, params: Maintenance = MAINTENANCE) -> DataFrame:
    """(memory_id, rate_before, rate_after): decay rates after signals of durability, one after the other.

    A durable memory's rate falls by up to ``scale`` of itself, another one's rises, to 2 at most. A rate of 0 stays.
    The first rate is the memory's own, else its category's. Signals are ordered by time, then id, those without a time first.
    """
    start = memories.select(F.col("id").alias("memory_id"), decay_rate(F.col("decay_rate"), F.col("category"), params).alias("rate_before"))

    def step(rate: float, row: dict) -> float:
        d = row["durability"]
        if rate == 0:
            return rate
        return max(0.0, rate * (1.0 - scale * d)) if d > 0 else min(2.0, rate * (1.0 + scale * abs(d)))

    made = lambda first, rate: {"memory_id": first["memory_id"], "rate_before": first["rate_before"], "rate_after": rate}
    rows = signals.join(start, "memory_id")
    return last_fold(rows.select("memory_id", "created_at", "id", "durability", "rate_before"), ["memory_id"], ["created_at", "id"], lambda row: row["rate_before"], step, made, "memory_id string, rate_before double, rate_after double")


def dormant(memories: DataFrame, edges: DataFrame, now: DataFrame, uses: int = 3, days: int = 60) -> DataFrame:
    """(id, age_days): active details that an active summary was derived from, used less than ``uses`` times and at least ``days`` old."""
    live = memories.where("status = 'active'")
    summaries = live.where("layer = 'summary'").select(F.col("id").alias("source_id"))
    covered = edges.where("edge_type = 'derived_from'").join(summaries, "source_id", "left_semi").select(F.col("target_id").alias("id")).distinct()
    few = F.coalesce("recall_count", F.lit(0)) + F.coalesce("reflect_count", F.lit(0)) < uses
    aged = live.where("layer = 'detail'").where(few).crossJoin(F.broadcast(now)).withColumn("age_days", days_between(F.col("now"), F.col("created_at")))  # now is one row
    return aged.where(F.col("age_days") >= days).join(covered, "id", "left_semi").select("id", "age_days")


def stale_summaries(memories: DataFrame, now: DataFrame, stub: int = 50, days: int = 90) -> DataFrame:
    """(id, problem): active summaries shorter than ``stub`` characters, and those untouched for ``days`` that are not their topic's newest."""
    live = memories.where("status = 'active' and layer = 'summary'").crossJoin(F.broadcast(now))  # one row
    stubs = live.where(F.length(F.coalesce("content", F.lit(""))) < stub).select("id", F.lit("stub").alias("problem"))
    newest = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.desc("created_at"), "id"))
    idle = (days_between(F.col("now"), F.coalesce("last_accessed", "created_at")) > days) & (F.coalesce("recall_count", F.lit(0)) + F.coalesce("reflect_count", F.lit(0)) < 2)
    old = live.where("topic_id is not null").withColumn("at", newest).where((F.col("at") > 1) & idle).select("id", F.lit("dormant").alias("problem"))
    return stubs.unionByName(old)


def mapped_themes(themes: Column, content: Column, variants: dict[str, str] = THEME_VARIANTS, phrases: dict[str, str] = CONTENT_PHRASES) -> Column:
    """Normal themes with variants replaced by what they stand for and the themes that the content's phrases imply, each once."""
    table = F.create_map(*[F.lit(x) for pair in variants.items() for x in pair])
    own = F.transform(normal_themes(themes), lambda t: F.coalesce(table[t], t))
    implied = [F.when(F.contains(F.lower(content), F.lit(phrase)), F.lit(tag)) for phrase, tag in phrases.items()]
    return F.array_distinct(F.concat(own, F.array_compact(F.array(*implied))))
