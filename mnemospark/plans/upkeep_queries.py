"""Queries of upkeep by rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.text import strip_secrets
from mnemospark.operators import upkeep as U
from mnemospark.operators.graph import distinct_edges
from mnemospark.plans import parts as P
from mnemospark.plans.parts import r6
from mnemospark.sources.tables import table


def decay_adjusted(spark: SparkSession, folder: str) -> DataFrame:
    """Decay rates of memories after all signals of their durability."""
    found = U.decay_after(U.durabilities(table(spark, folder, "memory_events")), P.memories(spark, folder))
    return found.select("memory_id", r6("rate_before").alias("rate_before"), F.round("rate_after", 9).alias("rate_after"))


def memories_dormant(spark: SparkSession, folder: str) -> DataFrame:
    """Details that summaries cover and nobody uses."""
    found = U.dormant(P.memories(spark, folder), distinct_edges(table(spark, folder, "memory_edges")), P.now(spark, folder))
    return found.select("id", r6("age_days").alias("age_days"))


def summaries_stale(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries that are stubs, and idle ones that are not the newest of their topic."""
    return U.stale_summaries(P.memories(spark, folder), P.now(spark, folder))


def themes_mapped(spark: SparkSession, folder: str) -> DataFrame:
    """Themes with variants mapped and themes that contents imply, where that changes anything."""
    rows = P.active(spark, folder).select("id", "themes", U.mapped_themes(F.col("themes"), F.coalesce("content", F.lit(""))).alias("new"))
    return rows.where(~F.col("new").eqNullSafe(F.col("themes"))).select("id", F.array_join("new", "|").alias("themes"))


def time_expressions(spark: SparkSession, folder: str) -> DataFrame:
    """How often documents name times."""
    return table(spark, folder, "documents").select("doc_id", U.time_expressions(F.col("text")).alias("times")).where("times > 0")


def secrets_planted(spark: SparkSession, folder: str) -> DataFrame:
    """Contents with a secret of each kind put before them, made of the memory's own id and content, after stripping."""
    long = F.md5(F.col("id").cast("binary"))
    number = F.translate(F.substring(long, 1, 12), "abcdef", "012345")
    kinds = [
        F.concat(F.lit("sk-"), long), F.concat(F.lit("eyJ"), long, F.lit(".eyJ"), long, F.lit("."), long), F.concat(F.lit("Bearer "), long), F.concat(F.lit("postgresql://u:p@"), long),
        F.concat(F.lit("password = "), long), F.concat(F.lit("ghp_"), long, F.lit("abcd")), F.concat(F.lit("xoxb-"), long), F.concat(F.lit("AKIA"), F.upper(F.substring(long, 1, 16))),
        F.concat(F.lit("AIza"), long, F.lit("xyz")), F.concat(F.lit("4"), number), F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), long, F.lit("\n-----END RSA PRIVATE KEY-----")),
    ]
    kind = F.pmod(F.conv(F.substring(long, 1, 4), 16, 10).cast("int"), F.lit(len(kinds)))
    text = F.concat(F.lit("note "), F.element_at(F.array(*kinds), kind + 1), F.lit(" end. "), F.coalesce("content", F.lit("")))
    return P.active(spark, folder).select("id", kind.alias("kind"), F.md5(strip_secrets(text).cast("binary")).alias("clean_md5"))


QUERIES = {f.__name__: f for f in (decay_adjusted, memories_dormant, summaries_stale, themes_mapped, time_expressions, secrets_planted)}

_TIME = r"\b(?:(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\b|20\d{2}|yesterday|today|tomorrow|(?:last|next|this)\s+(?:week|month|year|summer|winter|spring|fall)|\d{1,2}/\d{1,2}(?:/\d{2,4})?|\d{1,2}\s+(?:days?|weeks?|months?|years?)\s+ago)"
_FROM, _TO = "list_transform({}, lambda t: CASE t WHEN 'recall_feedback' THEN 'recall-feedback' WHEN 'startup_load' THEN 'startup-load' WHEN 'decisions' THEN 'decision' ELSE t END)", "list_concat(m, list_filter([CASE WHEN contains(c, 'memory system') THEN 'memory-system' END, CASE WHEN contains(c, 'sleep pipeline') THEN 'sleep-pipeline' END], lambda t: t IS NOT NULL))"

SQL = {
    "decay_adjusted": P.ctes(P.MEM, P.NOW, P.RATED, """du AS (SELECT id, any_value(memory_id) AS memory_id, any_value(created_at) AS created_at, any_value(TRY_CAST(json_extract_string(context, '$.durability') AS DOUBLE)) AS d FROM memory_events
        WHERE event_type = 'feedback' AND memory_id IS NOT NULL AND id IS NOT NULL AND abs(TRY_CAST(json_extract_string(context, '$.durability') AS DOUBLE)) > 0.01 GROUP BY id)""",
      "so AS (SELECT memory_id, list(d ORDER BY created_at NULLS FIRST, id) AS u FROM du GROUP BY memory_id)")
    + """SELECT memory_id, round(rate, 6) AS rate_before, round(list_reduce(list_prepend(rate, u), lambda a, x: CASE WHEN a = 0 THEN a WHEN x > 0 THEN greatest(0.0::DOUBLE, a * (1 - 0.2::DOUBLE * x)) ELSE least(2.0::DOUBLE, a * (1 + 0.2::DOUBLE * abs(x))) END), 9) AS rate_after FROM so JOIN rated ON rated.id = so.memory_id""",
    "memories_dormant": P.ctes(P.MEM, P.NOW, "cv AS (SELECT DISTINCT e.target_id AS id FROM memory_edges e JOIN act s ON s.id = e.source_id WHERE e.edge_type = 'derived_from' AND s.layer = 'summary' AND e.id IS NOT NULL)")
    + "SELECT id, round((epoch_us(now) - epoch_us(created_at)) / 86400e6, 6) AS age_days FROM act, clock WHERE layer = 'detail' AND coalesce(recall_count, 0) + coalesce(reflect_count, 0) < 3 AND (epoch_us(now) - epoch_us(created_at)) / 86400e6 >= 60 AND id IN (SELECT id FROM cv)",
    "summaries_stale": P.ctes(P.MEM, P.NOW) + """SELECT id, 'stub' AS problem FROM act WHERE layer = 'summary' AND length(coalesce(content, '')) < 50
      UNION ALL SELECT id, 'dormant' FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY created_at DESC NULLS LAST, id) AS n FROM act WHERE layer = 'summary' AND topic_id IS NOT NULL), clock
      WHERE n > 1 AND (epoch_us(now) - epoch_us(coalesce(last_accessed, created_at))) / 86400e6 > 90 AND coalesce(recall_count, 0) + coalesce(reflect_count, 0) < 2""",
    "themes_mapped": P.ctes(P.MEM, f"a AS (SELECT id, themes, lower(coalesce(content, '')) AS c, {_FROM.format(P.NORMAL)} AS m FROM act)", f"b AS (SELECT id, themes, {_TO} AS l FROM a)", f"c AS (SELECT id, themes, {P.distinct_list('l')} AS new FROM b)")
    + "SELECT id, coalesce(array_to_string(new, '|'), '') AS themes FROM c WHERE new IS DISTINCT FROM themes",
    "time_expressions": f"SELECT doc_id, times FROM (SELECT doc_id, len(regexp_extract_all(regexp_replace(text, '[À-ÖØ-öø-ʯͰ-ӿ]', 'x', 'g'), '{_TIME}', 0, 'i'))::INTEGER AS times FROM documents) WHERE times > 0",  # letters beyond ASCII are no word characters to this engine
    "secrets_planted": P.ctes(P.MEM) + """SELECT id, kind, md5('note ' || ['[REDACTED_API_KEY]', '[REDACTED_JWT]', '[REDACTED_BEARER_TOKEN]', '[REDACTED_CONN_STRING]', '[REDACTED_PASSWORD]', '[REDACTED_GITHUB_TOKEN]', '[REDACTED_SLACK_TOKEN]', '[REDACTED_AWS_KEY]',
      '[REDACTED_GOOGLE_API_KEY]', '[REDACTED_CREDIT_CARD]', '[REDACTED_PRIVATE_KEY]'][kind + 1] || ' end. ' || coalesce(content, '')) AS clean_md5 FROM (SELECT id, content, (('0x' || substr(md5(id), 1, 4))::INTEGER % 11)::INTEGER AS kind FROM act)""",
}
