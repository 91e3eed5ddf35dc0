"""Queries about the store's contents and upkeep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.scores import days_between, effective_priority
from mnemospark.functions.text import SECRETS, auto_summary, compact_line, enriched, full_text, normal_themes, strip_secrets
from mnemospark.operators import maintenance as M
from mnemospark.operators.graph import first_vectors
from mnemospark.operators.nearest import nearest_before
from mnemospark.plans import parts as P
from mnemospark.plans.parts import r6
from mnemospark.sources.tables import table


def stats_by_status(spark: SparkSession, folder: str) -> DataFrame:
    return P.memories(spark, folder).groupBy("status", "category").agg(F.count(F.lit(1)).alias("memories"))


def stats_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Extension: the same counts with subtotals."""
    return P.memories(spark, folder).rollup("status", "category").agg(F.count(F.lit(1)).alias("memories"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens"))


def stats_overview(spark: SparkSession, folder: str) -> DataFrame:
    return M.overview(P.memories(spark, folder), P.now(spark, folder)).withColumn("mean_confidence", r6("mean_confidence"))


def stats_top_recalled(spark: SparkSession, folder: str) -> DataFrame:
    uses = F.coalesce("recall_count", F.lit(0)) + F.coalesce("reflect_count", F.lit(0))
    return P.active(spark, folder).select("id", "category", uses.alias("uses")).orderBy(F.desc("uses"), "id").limit(5)


def stats_event_types(spark: SparkSession, folder: str) -> DataFrame:
    return P.events(spark, folder).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("memory_id").alias("memories"))


def stats_feedback(spark: SparkSession, folder: str) -> DataFrame:
    return P.feedback(spark, folder).agg(F.count_distinct("memory_id").alias("memories"), F.count(F.lit(1)).alias("ratings"), r6(F.avg("utility")).alias("mean_utility"), F.count_if(F.col("utility") >= 0.5).alias("useful"))


def decay_priority(spark: SparkSession, folder: str) -> DataFrame:
    value = effective_priority(F.col("base_priority"), F.col("last_accessed"), F.col("decay_rate"), F.col("category"), F.col("flags"), F.col("now"))
    return P.memories(spark, folder).crossJoin(F.broadcast(P.now(spark, folder))).select("id", r6(value).alias("effective_priority"))


def id_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    return M.prefix_table(table(spark, folder, "memories"), 5)


def format_compact(spark: SparkSession, folder: str) -> DataFrame:
    return P.active(spark, folder).select("id", compact_line(F.col("category"), F.col("summary"), F.col("content"), F.col("themes")).alias("line"))


def embed_text(spark: SparkSession, folder: str) -> DataFrame:
    return P.active(spark, folder).select("id", F.md5(enriched(F.col("content"), F.col("category"), F.col("themes"), F.col("summary")).cast("binary")).alias("text_md5"))


def secrets_stripped(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("text is not null").select("doc_id", "text", strip_secrets(F.col("text")).alias("clean"))
    return docs.where("clean <> text").select("doc_id", F.md5(F.col("clean").cast("binary")).alias("clean_md5"))


def themes_normalised(spark: SparkSession, folder: str) -> DataFrame:
    rows = P.memories(spark, folder).where("status in ('active', 'pending')").select("id", normal_themes(F.col("themes")).alias("new"), "themes")
    return rows.where(~F.col("new").eqNullSafe(F.col("themes"))).select("id", F.array_join("new", "|").alias("themes"))


def themes_counted(spark: SparkSession, folder: str) -> DataFrame:
    return M.theme_counts(P.memories(spark, folder))


def themes_variants(spark: SparkSession, folder: str) -> DataFrame:
    return M.theme_variants(M.theme_counts(P.memories(spark, folder)))


def themes_quality(spark: SparkSession, folder: str) -> DataFrame:
    seen = P.events(spark, folder, "event_type = 'retrieved'")
    return M.theme_quality(P.memories(spark, folder), P.feedback(spark, folder), seen).withColumn("quality", r6("quality"))


def events_archived(spark: SparkSession, folder: str) -> DataFrame:
    """How many events retention keeps and archives, by month."""
    kept, old = M.retention(table(spark, folder, "memory_events"), P.now(spark, folder))
    both = kept.withColumn("part", F.lit("kept")).unionByName(old.withColumn("part", F.lit("archived")))
    return both.groupBy("part", F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("events"))


def pending_stale(spark: SparkSession, folder: str) -> DataFrame:
    rows = P.memories(spark, folder).where("status = 'pending'").crossJoin(F.broadcast(P.now(spark, folder)))
    return rows.where(days_between(F.col("now"), F.col("created_at")) > 14).select("id")


def source_confidence(spark: SparkSession, folder: str) -> DataFrame:
    known = {"manual": 1.0, "correction": 0.95, "session": 0.9, "journal": 0.9, "auto": 0.7}
    value = reduce(lambda w, kv: w.when(F.col("source") == kv[0], kv[1]), known.items(), F.when(F.lit(False), 0.0)).otherwise(0.8)
    return P.active(spark, folder).groupBy("source", value.alias("source_confidence")).agg(F.count(F.lit(1)).alias("memories"))


def similarity_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return M.similarity_histogram(P.events(spark, folder, "event_type = 'retrieved'"))


def topics_health(spark: SparkSession, folder: str) -> DataFrame:
    return M.topic_health(P.memories(spark, folder), P.now(spark, folder)).withColumn("vitality", r6("vitality"))


def store_health(spark: SparkSession, folder: str) -> DataFrame:
    mem = P.memories(spark, folder)
    found = M.health(mem, M.topic_health(mem, P.now(spark, folder)), P.feedback(spark, folder))
    return found.select(*[r6(c).alias(c) for c in ("shadowed", "stale", "silent", "risk")])


def batches_by_topic(spark: SparkSession, folder: str) -> DataFrame:
    rows = P.active(spark, folder).where("topic_id is not null").select("topic_id", "created_at", "id", F.coalesce("token_count", F.lit(0)).alias("tokens"))
    return M.token_batches(rows, "topic_id", ["created_at", "id"], 2000).select("topic_id", "id", "batch")


def superseded_kept(spark: SparkSession, folder: str) -> DataFrame:
    return M.newest_per_topic(P.memories(spark, folder)).select("topic_id", "id", "place")


def format_full(spark: SparkSession, folder: str) -> DataFrame:
    text = full_text(F.col("category"), F.col("summary"), F.col("content"), F.col("themes"), F.col("id"))
    return P.active(spark, folder).select("id", F.md5(text.cast("binary")).alias("text_md5"))


def summaries_made(spark: SparkSession, folder: str) -> DataFrame:
    """What short memories without a summary would be summarised as."""
    rows = P.memories(spark, folder).where("summary is null and content <> ''")
    return rows.select("id", auto_summary(F.col("content"), F.coalesce("token_count", F.ceil(F.length("content") / 4).cast("int"))).alias("summary")).where("summary is not null")


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Active memories that say nearly the same as one of their category that would stay, linked or not, and the nearest such."""
    live = P.active(spark, folder)
    vectors = first_vectors(table(spark, folder, "memory_vec")).select(F.col("memory_id").alias("id"), F.col("embedding").alias("vector"))
    rows = live.select("id", F.col("category").alias("kind"), (-F.coalesce("base_priority", F.lit(0))).alias("place")).join(vectors, "id")
    near = nearest_before(rows, ties=True, least=0.849, digits=6)  # a little under the similarity of distance 0.15, which is rounded
    pairs = near.select(F.least("id", "other").alias("low"), F.greatest("id", "other").alias("high"), "cosine")
    return M.near_duplicates(pairs, P.memories(spark, folder)).select("loser", "winner", "distance")


def event_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Events by type up to the last thirty days, and in them."""
    dated = P.events(spark, folder, "created_at is not null").crossJoin(F.broadcast(P.now(spark, folder)))  # one row
    recent = days_between(F.col("now"), F.col("created_at")) <= 30
    return M.changes(dated.where(~recent), dated.where(recent), "event_type")


def label_bins(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings by bands of utility."""
    edges = (0.1, 0.3, 0.5, 0.7, 0.9)
    bin_ = sum(((F.col("utility") >= e).cast("int") for e in edges), F.lit(0))
    return P.feedback(spark, folder).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("ratings"), r6(F.avg("utility")).alias("mean"))


QUERIES = {f.__name__: f for f in (
    format_full, summaries_made, near_duplicates, event_changes, label_bins,
    stats_by_status, stats_rollup, stats_overview, stats_top_recalled, stats_event_types, stats_feedback, decay_priority, id_prefixes, format_compact, embed_text,
    secrets_stripped, themes_normalised, themes_counted, themes_variants, themes_quality, events_archived, pending_stale, source_confidence, similarity_buckets,
    topics_health, store_health, batches_by_topic, superseded_kept,
)}

_COUNTS = f"tc AS (SELECT theme, count(*) AS memories FROM (SELECT id, unnest({P.NORMAL}) AS theme FROM mem) GROUP BY theme)"
_TOPICS = """newest AS (SELECT topic_id, max(created_at) AS summarised, count(*) AS summaries FROM act WHERE layer <> 'detail' AND topic_id IS NOT NULL GROUP BY topic_id),
topics AS (SELECT topic_id, details, summaries, new_details, tokens, vitality, new_details >= greatest(2, ceil(details * 0.2)) AS stale, details >= 5 AND summaries = 0 AS gap FROM (
  SELECT a.topic_id, count(*) AS details, coalesce(max(summaries), 0)::BIGINT AS summaries, count(*) FILTER (summarised IS NULL OR a.created_at > summarised) AS new_details,
    coalesce(sum(token_count), 0)::BIGINT AS tokens, sum(exp(-0.05::DOUBLE * greatest(0.0::DOUBLE, (epoch_us(now) - epoch_us(a.created_at)) / 86400e6))) AS vitality
  FROM act a LEFT JOIN newest n ON a.topic_id = n.topic_id, clock WHERE a.layer = 'detail' AND a.topic_id IS NOT NULL GROUP BY a.topic_id))"""


def _redacted(text: str) -> str:
    for pattern, marker in SECRETS:
        text = f"regexp_replace({text}, '{pattern}', '{marker}', 'g')"
    return text


SQL = {
    "format_full": P.ctes(P.MEM, "t AS (SELECT *, coalesce(themes, []::VARCHAR[]) AS th FROM act)") + """SELECT id, md5(concat_ws(chr(10), '**[' || category || ']** ' || coalesce(nullif(summary, ''), '(no summary)'), '  ' || content,
      '  ID: ' || left(id, 8) || CASE WHEN len(th) > 0 THEN ' (' || coalesce(array_to_string(th, ', '), '') || ')' ELSE '' END)) AS text_md5 FROM t""",
    "summaries_made": P.ctes(P.MEM, r"f AS (SELECT id, content, coalesce(token_count, ceil(length(content) / 4)::INTEGER) AS n, regexp_extract(content, '^[^.!?\n]*[.!?]?') AS s FROM mem WHERE summary IS NULL AND content <> '')")
    + "SELECT id, CASE WHEN length(s) <= 80 THEN trim(s, ' ') ELSE substring(content, 1, 80) END AS summary FROM f WHERE n < 50",
    "near_duplicates": P.ctes(P.MEM, "vc AS (SELECT memory_id, any_value(embedding)::DOUBLE[] AS e FROM memory_vec WHERE len(embedding) = 384 AND memory_id IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY memory_id)",
      """c AS (SELECT x.id AS low, y.id AS high, round(1 - list_cosine_similarity(a.e, b.e), 6) AS d, coalesce(x.base_priority, 0) AS pa, coalesce(y.base_priority, 0) AS pb FROM act x JOIN act y ON x.category = y.category AND x.id < y.id
        JOIN vc a ON a.memory_id = x.id JOIN vc b ON b.memory_id = y.id)""")
    + "SELECT loser, arg_min(winner, (d, winner)) AS winner, min(d) AS distance FROM (SELECT CASE WHEN pb > pa THEN low ELSE high END AS loser, CASE WHEN pb > pa THEN high ELSE low END AS winner, d FROM c WHERE d <= 0.15) GROUP BY loser",
    "event_changes": P.ctes(P.EVT, P.NOW) + f"""SELECT event_type, b AS before, a AS after, a - b AS delta FROM (SELECT event_type, count(*) FILTER (NOT recent) AS b, count(*) FILTER (recent) AS a FROM (
      SELECT event_type, {P.DAYS.format('now', 'created_at')} <= 30 AS recent FROM evt, clock WHERE created_at IS NOT NULL) GROUP BY event_type)""",
    "label_bins": P.ctes(P.FB) + "SELECT ((utility >= 0.1)::INTEGER + (utility >= 0.3)::INTEGER + (utility >= 0.5)::INTEGER + (utility >= 0.7)::INTEGER + (utility >= 0.9)::INTEGER)::INTEGER AS bin, count(*) AS ratings, round(avg(utility), 6) AS mean FROM fb GROUP BY bin",
    "stats_by_status": P.ctes(P.MEM) + "SELECT status, category, count(*) AS memories FROM mem GROUP BY ALL",
    "stats_rollup": P.ctes(P.MEM) + "SELECT status, category, count(*) AS memories, coalesce(sum(token_count), 0)::BIGINT AS tokens FROM mem GROUP BY ROLLUP (status, category)",
    "stats_overview": P.ctes(P.MEM, P.NOW, P.RATED) + f"""SELECT count(*) AS active, coalesce(sum(token_count), 0)::BIGINT AS tokens,
      count(*) FILTER (recall_count = 0 AND reflect_count = 0) AS never_accessed, count(*) FILTER ({P.DAYS.format('now', 'last_accessed')} < 7) AS recently_accessed,
      count(*) FILTER ({P.PRIORITY} < base_priority * 0.5) AS near_floor, count(decay_rate) AS own_decay_rate, round(avg(confidence), 6) AS mean_confidence,
      count(*) FILTER (confidence < 0.4) AS low_confidence, count(*) FILTER (confidence > 0.8) AS high_confidence,
      count(*) FILTER (last_sleep_processed IS NULL) AS unprocessed, min(created_at) AS oldest, max(created_at) AS newest FROM rated WHERE status = 'active'""",
    "stats_top_recalled": P.ctes(P.MEM) + "SELECT id, category, (coalesce(recall_count, 0) + coalesce(reflect_count, 0))::INTEGER AS uses FROM act ORDER BY uses DESC, id LIMIT 5",
    "stats_event_types": P.ctes(P.EVT) + "SELECT event_type, count(*) AS events, count(DISTINCT memory_id) AS memories FROM evt GROUP BY event_type",
    "stats_feedback": P.ctes(P.FB) + "SELECT count(DISTINCT memory_id) AS memories, count(*) AS ratings, round(avg(utility), 6) AS mean_utility, count(*) FILTER (utility >= 0.5) AS useful FROM fb",
    "decay_priority": P.ctes(P.MEM, P.NOW, P.RATED) + f"SELECT id, round({P.PRIORITY}, 6) AS effective_priority FROM rated",
    "id_prefixes": "SELECT left(id, 5) AS prefix, min(id) AS id FROM (SELECT DISTINCT id FROM memories WHERE id IS NOT NULL) GROUP BY 1 HAVING count(*) = 1",
    "format_compact": P.ctes(P.MEM, "t AS (SELECT *, coalesce(themes, []::VARCHAR[]) AS th FROM act)") + """SELECT id, CASE WHEN list_contains(th, 'question') THEN '[?]' ELSE '[' || category || ']' END || ' '
      || coalesce(nullif(summary, ''), substring(content, 1, 80)) || CASE WHEN len(th) > 5 THEN ' (' || array_to_string(th[1:5], ', ') || ', ...)' WHEN len(th) > 0 THEN ' (' || array_to_string(th, ', ') || ')' ELSE '' END AS line FROM t""",
    "embed_text": P.ctes(P.MEM, "t AS (SELECT *, coalesce(themes, []::VARCHAR[]) AS th FROM act)") + r"""SELECT id, md5(concat_ws(chr(10), content, CASE WHEN category <> '' THEN 'Category: ' || category END,
      CASE WHEN len(th) > 0 THEN 'Themes: ' || coalesce(array_to_string(th, ', '), '') END, CASE WHEN summary <> '' THEN 'Summary: ' || summary END)) AS text_md5 FROM t""",
    "secrets_stripped": f"SELECT doc_id, md5(clean) AS clean_md5 FROM (SELECT doc_id, text, {_redacted('text')} AS clean FROM documents WHERE text IS NOT NULL) WHERE clean <> text",
    "themes_normalised": P.ctes(P.MEM) + f"SELECT id, coalesce(array_to_string(new, '|'), '') AS themes FROM (SELECT id, themes, {P.NORMAL} AS new FROM mem WHERE status IN ('active', 'pending')) WHERE new IS DISTINCT FROM themes",
    "themes_counted": P.ctes(P.MEM, _COUNTS) + "SELECT theme, memories FROM tc",
    "themes_variants": P.ctes(P.MEM, _COUNTS, r"""k AS (SELECT *, regexp_replace(bare, '(?:s|ing)$', '') AS stem FROM (SELECT *, regexp_replace(lower(theme), '[-_\s]', '', 'g') AS bare FROM tc)),
b AS (SELECT *, first_value(theme) OVER w AS keep, first_value(memories) OVER w AS n_keep FROM k WINDOW w AS (PARTITION BY bare ORDER BY memories DESC, theme)),
s AS (SELECT *, first_value(theme) OVER w AS keep, first_value(memories) OVER w AS n_keep, first_value(bare) OVER w AS keep_bare FROM k WINDOW w AS (PARTITION BY stem ORDER BY memories DESC, theme))""")
    + """SELECT theme AS variant, keep AS theme, 'form' AS reason, memories AS n_variant, n_keep AS n_theme FROM b WHERE theme <> keep
      UNION ALL SELECT theme, keep, 'ending', memories, n_keep FROM s WHERE theme <> keep AND bare <> keep_bare""",
    "themes_quality": P.ctes(P.MEM, P.EVT, P.FB, "u AS (SELECT memory_id, sum(utility::DECIMAL(18,9))::DOUBLE / count(*) AS mean FROM fb GROUP BY 1)", "seen AS (SELECT DISTINCT memory_id FROM evt WHERE event_type = 'retrieved')")
    + f"""SELECT theme, count(*) AS memories, round(sum(q::DECIMAL(18,9))::DOUBLE / count(*), 6) AS quality, sum(q::DECIMAL(18,9))::DOUBLE / count(*) < 0.5 AS underserved FROM (
      SELECT unnest({P.NORMAL}) AS theme, coalesce(u.mean, CASE WHEN seen.memory_id IS NOT NULL THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) AS q
      FROM act LEFT JOIN u ON u.memory_id = act.id LEFT JOIN seen ON seen.memory_id = act.id) GROUP BY theme""",
    "events_archived": P.ctes(P.EVT, P.NOW) + f"""SELECT CASE WHEN event_type = 'retrieved' AND {P.DAYS.format('now', 'created_at')} > 90 THEN 'archived' ELSE 'kept' END AS part,
      strftime(created_at, '%Y-%m') AS month, count(*) AS events FROM evt, clock GROUP BY ALL""",
    "pending_stale": P.ctes(P.MEM, P.NOW) + f"SELECT id FROM mem, clock WHERE status = 'pending' AND {P.DAYS.format('now', 'created_at')} > 14",
    "source_confidence": P.ctes(P.MEM) + "SELECT source, CASE source WHEN 'manual' THEN 1.0 WHEN 'correction' THEN 0.95 WHEN 'session' THEN 0.9 WHEN 'journal' THEN 0.9 WHEN 'auto' THEN 0.7 ELSE 0.8 END::DOUBLE AS source_confidence, count(*) AS memories FROM act GROUP BY ALL",
    "similarity_buckets": P.ctes(P.EVT) + """SELECT bucket, count(*) FILTER (kind = 'alone') AS alone, count(*) FILTER (kind = 'few') AS few, count(*) FILTER (kind = 'many') AS many FROM (
      SELECT floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, similarity_score)) / 0.05::DOUBLE + 1e-9)::INTEGER AS bucket,
        CASE WHEN len(coalesce(co_memory_ids, [])) = 0 THEN 'alone' WHEN len(co_memory_ids) <= 4 THEN 'few' ELSE 'many' END AS kind FROM evt WHERE event_type = 'retrieved') GROUP BY bucket""",
    "topics_health": P.ctes(P.MEM, P.NOW, _TOPICS) + "SELECT topic_id, details, summaries, new_details, tokens, round(vitality, 6) AS vitality, stale, gap FROM topics",
    "store_health": P.ctes(P.MEM, P.NOW, P.FB, _TOPICS) + """SELECT round(shadowed, 6) AS shadowed, round(stale, 6) AS stale, round(silent, 6) AS silent, round(0.4::DOUBLE * shadowed + 0.3::DOUBLE * stale + 0.3::DOUBLE * silent, 6) AS risk FROM
      (SELECT avg((coalesce(shadow_load, 0) > 0.5)::INTEGER) AS shadowed FROM act), (SELECT avg(stale::INTEGER) AS stale FROM topics),
      (SELECT avg((topic_id NOT IN (SELECT topic_id FROM act WHERE topic_id IS NOT NULL AND id IN (SELECT memory_id FROM fb)))::INTEGER) AS silent FROM topics)""",
    "superseded_kept": P.ctes(P.MEM) + "SELECT topic_id, id, place::INTEGER AS place FROM (SELECT topic_id, id, row_number() OVER (PARTITION BY topic_id ORDER BY created_at DESC NULLS LAST, id) AS place FROM mem WHERE status = 'deleted' AND topic_id IS NOT NULL) WHERE place <= 2",
    "batches_by_topic": """WITH RECURSIVE """ + P.MEM + """,
o AS (SELECT topic_id, id, coalesce(token_count, 0)::BIGINT AS t, row_number() OVER (PARTITION BY topic_id ORDER BY created_at NULLS FIRST, id) AS n FROM act WHERE topic_id IS NOT NULL),
w(topic_id, id, n, used, batch) AS (SELECT topic_id, id, n, t, 0 FROM o WHERE n = 1 UNION ALL
  SELECT o.topic_id, o.id, o.n, CASE WHEN w.used > 0 AND w.used + o.t > 2000 THEN o.t ELSE w.used + o.t END, w.batch + CASE WHEN w.used > 0 AND w.used + o.t > 2000 THEN 1 ELSE 0 END
  FROM w JOIN o ON o.topic_id = w.topic_id AND o.n = w.n + 1)
SELECT topic_id, id, batch::INTEGER AS batch FROM w""",
}
