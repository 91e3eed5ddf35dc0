"""Queries that recall with the vector channel, filter what was ranked, and relate stored memories to each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.scores import days_between
from mnemospark.operators import recall as C
from mnemospark.operators import retrieval as R
from mnemospark.operators.graph import diversity, first_vectors, linked_cosines
from mnemospark.plans import parts as P
from mnemospark.plans import retrieval_queries as Q
from mnemospark.plans.parts import r6
from mnemospark.runtime import checkpoint
from mnemospark.sources.tables import table


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    live = P.active(spark, folder).select(F.col("id").alias("memory_id"))
    return first_vectors(table(spark, folder, "memory_vec")).join(live, "memory_id", "left_semi")


def _channels(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    keywords, themes = Q._channels(spark, folder)
    keywords, vectors = checkpoint(keywords), _vectors(spark, folder)
    asked = checkpoint(C.query_vectors(keywords, vectors))
    near = R.vector_channel(asked, vectors.select(F.col("memory_id").alias("id"), F.col("embedding").alias("vector")), k=200).withColumnRenamed("id", "memory_id")
    return keywords, themes, checkpoint(near)


def _fused(spark: SparkSession, folder: str) -> DataFrame:
    return C.three_channels(*_channels(spark, folder)).withColumn("score", F.round("score", 9))


def recall_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best memories of each query by keywords, themes and vectors; a query's vector is the mean of its first keyword hits'."""
    best = R.top_k(_fused(spark, folder), "query_id", [F.desc("score"), F.col("memory_id")], 10)
    return best.select("query_id", "memory_id", r6("score").alias("score"), F.col("rank").cast("int").alias("rank"))


def recall_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """The same, of memories that are no older than a year, are no procedures, have priority 3 or more and were not superseded."""
    now = P.now(spark, folder)
    held = P.active(spark, folder).crossJoin(F.broadcast(now)).select(F.col("id").alias("memory_id"), "category", "base_priority", "created_at", "superseded_by", C.since_time(F.lit("365d"), F.col("now")).alias("since"))  # now is one row
    keep = (F.col("created_at").cast("timestamp") >= F.col("since")) & (F.col("category") != "procedural") & (F.col("base_priority") >= 3) & (F.coalesce("superseded_by", F.lit("")) == "")
    best = C.filtered(_fused(spark, folder), held, keep)
    return best.select("query_id", "memory_id", r6("score").alias("score"), F.col("rank").cast("int").alias("rank"))


_ASKED_BY = "substring(md5(cast({} as binary)), 1, 2) < '05'"


def related_memories(spark: SparkSession, folder: str) -> DataFrame:
    """Five related memories of each of a stated set of active ones: those whose id's hash (MD5) begins below 05."""
    live = P.active(spark, folder)
    asked = live.where(_ASKED_BY.format("id")).select(F.col("id").alias("memory_id"), "content")
    vectors = table(spark, folder, "memory_vec").where("memory_id is not null and size(embedding) = 384")
    own = vectors.where(_ASKED_BY.format("memory_id"))
    found = C.related(checkpoint(asked), checkpoint(live.select("id", "summary", "themes")), vectors, own=own)
    return found.select("memory_id", "related_id", r6("score").alias("score"), F.col("rank").cast("int").alias("rank"))


def features_channels(spark: SparkSession, folder: str) -> DataFrame:
    """What the three channels say of each candidate, and traits of the memory that the other features lack."""
    keywords, themes, near = _channels(spark, folder)
    found = C.channel_features(C.three_channels(keywords, themes, near).withColumn("score", F.round("score", 9)), keywords, themes, near)
    now = F.broadcast(P.now(spark, folder))  # one row
    spread = diversity(linked_cosines(table(spark, folder, "memory_edges"), table(spark, folder, "memory_vec")))
    own = P.active(spark, folder).crossJoin(now).select(
        F.col("id").alias("memory_id"), days_between(F.col("now"), F.col("last_accessed")).alias("days_since_access"), F.coalesce("recall_count", F.lit(0)).alias("recall_count"),
        F.coalesce("reflect_count", F.lit(0)).alias("reflect_count"), F.coalesce("shadow_load", F.lit(0.0)).alias("shadow_load"), F.col("layer"), F.length("content").alias("content_length"),
    )
    rows = found.join(own, "memory_id").join(spread, "memory_id", "left")
    for c in ("keyword_rank", "theme_rank", "vector_rank"):
        rows = rows.withColumn(c, F.col(c).cast("double"))  # null where a channel doesn't list the candidate
    rows = rows.withColumn("diversity", F.round("diversity", 5)).withColumn("vector_distance", r6("vector_distance"))
    return rows.select(*[r6(c).alias(c) if k == "double" and c != "diversity" else F.col(c) for c, k in rows.dtypes])


def features_density(spark: SparkSession, folder: str) -> DataFrame:
    """How many candidates of the same query stand within two places of each one in its session."""
    return C.pool_density(Q._fused(spark, folder), P.active(spark, folder))


QUERIES = {f.__name__: f for f in (recall_vectors, recall_filtered, related_memories, features_channels, features_density)}

_LIVE = "lv AS (SELECT memory_id, e FROM vc JOIN act ON act.id = vc.memory_id)"
_NEAR = """qi AS (SELECT query_id, i, avg(x) AS x FROM (SELECT query_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM kw JOIN lv ON lv.memory_id = kw.memory_id WHERE rank < 5) GROUP BY query_id, i),
qv AS (SELECT query_id, list(x ORDER BY i) AS v FROM qi GROUP BY query_id),
ve AS (SELECT query_id, memory_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, memory_id) - 1 AS rank FROM (SELECT query_id, memory_id, round(1 - list_cosine_similarity(v, e), 9) AS d FROM qv, lv) QUALIFY rank < 200)"""
_THREE = """f3 AS (SELECT query_id, memory_id, round(sum(p), 9) AS score FROM (SELECT query_id, memory_id, 0.495::DOUBLE / (8.002::DOUBLE + rank + 1) AS p FROM kw
  UNION ALL SELECT query_id, memory_id, 0.116::DOUBLE / (4.924::DOUBLE + rank + 1) FROM th UNION ALL SELECT query_id, memory_id, 0.505::DOUBLE / (6.845::DOUBLE + rank + 1) FROM ve) GROUP BY query_id, memory_id)"""
_BASE = (*Q._BASE, Q._VEC, _LIVE, _NEAR, _THREE)
_ASKED = f"""ak AS (SELECT id, content FROM act WHERE left(md5(id), 2) < '05'),
aw AS (SELECT id AS query_id, unnest(t) AS term, len(t) AS n_terms FROM (SELECT id, list_distinct(list_filter({P.WORDS.format("coalesce(left(content, 200), '')")}, lambda w: length(w) > 1)) AS t FROM ak))"""
_BM = "round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * (wtf * 2.2::DOUBLE / (wtf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avg_length)))), 9)"

SQL = {
    "recall_vectors": P.ctes(*_BASE) + Q._TOP10.format("f3"),
    "recall_filtered": P.ctes(*_BASE, P.NOW, "t AS (SELECT query_id, memory_id, score FROM f3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) <= 30)",
      "p AS (SELECT t.* FROM t JOIN act ON act.id = t.memory_id, clock WHERE created_at >= now - INTERVAL 365 DAY AND category <> 'procedural' AND base_priority >= 3 AND coalesce(superseded_by, '') = '')") + Q._TOP10.format("p"),
    "related_memories": P.ctes(P.MEM, Q._INDEX, Q._VEC, _LIVE, _ASKED,
      f"""k0 AS (SELECT query_id, memory_id, b, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, memory_id) AS at0 FROM (SELECT query_id, memory_id, {_BM} AS b, count(*) AS m, any_value(n_terms) AS nt
        FROM aw JOIN dfs ON aw.term = dfs.term JOIN post ON post.term = aw.term, st GROUP BY query_id, memory_id) WHERE nt > 3 OR m = nt QUALIFY at0 <= 16)""",
      "k1 AS (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY b DESC, memory_id) - 1 AS rank FROM k0 WHERE query_id <> memory_id QUALIFY rank < 15)",
      "v0 AS (SELECT a.memory_id AS query_id, b.memory_id, round(1 - list_cosine_similarity(a.e, b.e), 9) AS d FROM lv a JOIN ak ON ak.id = a.memory_id, lv b QUALIFY row_number() OVER (PARTITION BY a.memory_id ORDER BY d, b.memory_id) <= 16)",
      "v1 AS (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY d, memory_id) - 1 AS rank FROM v0 WHERE query_id <> memory_id QUALIFY rank < 15)",
      "u AS (SELECT query_id, memory_id, round(sum(p), 9) AS score FROM (SELECT query_id, memory_id, 0.495::DOUBLE / (7.0::DOUBLE + rank) AS p FROM k1 UNION ALL SELECT query_id, memory_id, 0.505::DOUBLE / (7.0::DOUBLE + rank) FROM v1) GROUP BY ALL)")
    + "SELECT query_id AS memory_id, memory_id AS related_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) - 1 AS rank FROM u) WHERE rank < 5",
    "features_channels": P.ctes(*_BASE, P.NOW, Q._PAIRS, "cs AS (SELECT low, high, list_cosine_similarity(a.e, b.e) AS cosine FROM pr JOIN vc a ON a.memory_id = low JOIN vc b ON b.memory_id = high)",
      "dv AS (SELECT m, round(1 - avg(cosine), 5) AS diversity FROM (SELECT low AS m, cosine FROM cs UNION ALL SELECT high, cosine FROM cs) GROUP BY m)")
    + """SELECT f3.query_id, f3.memory_id, round(score, 6) AS score, kw.rank::DOUBLE AS keyword_rank, th.rank::DOUBLE AS theme_rank, ve.rank::DOUBLE AS vector_rank, round(d, 6) AS vector_distance,
      round(CASE WHEN max(bm25) OVER w > 0 THEN bm25 / max(bm25) OVER w END, 6) AS keyword_share, round(CASE WHEN max(overlap) OVER w > 0 THEN overlap / max(overlap) OVER w END, 6) AS theme_share, round(1 - d, 6) AS vector_share, round(score / max(score) OVER w, 6) AS score_share,
      (kw.rank IS NOT NULL)::INTEGER + (th.rank IS NOT NULL)::INTEGER + (ve.rank IS NOT NULL)::INTEGER AS channels, round((epoch_us(now) - epoch_us(last_accessed)) / 86400e6, 6) AS days_since_access,
      coalesce(recall_count, 0) AS recall_count, coalesce(reflect_count, 0) AS reflect_count, round(coalesce(shadow_load, 0.0::DOUBLE), 6) AS shadow_load, layer, length(content)::INTEGER AS content_length, diversity
      FROM f3 JOIN act ON act.id = f3.memory_id LEFT JOIN kw ON kw.query_id = f3.query_id AND kw.memory_id = f3.memory_id LEFT JOIN th ON th.query_id = f3.query_id AND th.memory_id = f3.memory_id
      LEFT JOIN ve ON ve.query_id = f3.query_id AND ve.memory_id = f3.memory_id LEFT JOIN dv ON dv.m = f3.memory_id, clock WINDOW w AS (PARTITION BY f3.query_id)""",
    "features_density": P.ctes(*Q._BASE, "pl AS (SELECT id, session_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at NULLS FIRST, id) AS place FROM act WHERE session_id IS NOT NULL)",
      "x AS (SELECT query_id, memory_id, session_id, place FROM fu LEFT JOIN pl ON pl.id = fu.memory_id)")
    + "SELECT a.query_id, a.memory_id, count(b.memory_id) AS neighbours FROM x a LEFT JOIN x b ON b.query_id = a.query_id AND b.session_id = a.session_id AND b.memory_id <> a.memory_id AND abs(b.place - a.place) <= 2 GROUP BY a.query_id, a.memory_id",
}
