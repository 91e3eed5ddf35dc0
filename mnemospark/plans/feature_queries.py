"""Queries for ranking features and for second looks."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators import expansion as X
from mnemospark.operators import features as Y
from mnemospark.operators import retrieval as R
from mnemospark.operators.feedback import burstiness, feedback_summary
from mnemospark.operators.graph import degrees, first_vectors
from mnemospark.operators.selection import correlations
from mnemospark.plans import parts as P
from mnemospark.plans import retrieval_queries as Q
from mnemospark.plans.feedback_queries import SUMMARY
from mnemospark.plans.parts import r6
from mnemospark.runtime import checkpoint
from mnemospark.sources.tables import table


def _fused(spark: SparkSession, folder: str) -> DataFrame:
    return checkpoint(Q._fused(spark, folder).withColumn("score", F.round("score", 9)))


def _found(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(query_id, memory_id) of each query's first five keyword hits, and its pool; both of one search."""
    keywords, themes = Q._channels(spark, folder)
    keywords = checkpoint(keywords)
    return keywords.where("rank < 5").select("query_id", "memory_id"), checkpoint(Q._fused_of(keywords, themes).withColumn("score", F.round("score", 9)))


def features(spark: SparkSession, folder: str) -> DataFrame:
    now = P.now(spark, folder)
    timed = P.feedback(spark, folder).crossJoin(F.broadcast(now))  # one row
    seen = P.events(spark, folder, "event_type = 'retrieved'")
    found = Y.ranking_features(
        _fused(spark, folder), P.search_queries(spark, folder), P.active(spark, folder), feedback_summary(timed, F.col("now")), degrees(table(spark, folder, "memory_edges")), burstiness(seen), now
    )
    for c in ("keyword_rank", "theme_rank", "rank_gap"):
        found = found.withColumn(c, F.col(c).cast("double"))  # null where a channel doesn't list the candidate
    doubles = [c for c, k in found.dtypes if k == "double"]
    return found.select(*[r6(c).alias(c) if c in doubles else F.col(c) for c in found.columns])


def features_proximity(spark: SparkSession, folder: str) -> DataFrame:
    found = Y.proximity(_fused(spark, folder), P.search_queries(spark, folder), P.active(spark, folder))
    return found.select("query_id", "memory_id", r6("proximity").alias("proximity"))


CORRELATED = ("score", "theme_overlap", "query_coverage", "priority", "age_days", "token_count", "theme_count", "confidence", "decay_rate", "fb_count", "links", "burstiness")


def features_correlated(spark: SparkSession, folder: str) -> DataFrame:
    """Correlations of all pairs of features, the score among them."""
    return correlations(features(spark, folder), list(CORRELATED)).withColumn("correlation", r6("correlation"))


def _seeds(fused: DataFrame) -> DataFrame:
    return R.top_k(fused, "query_id", [F.desc("score"), F.col("memory_id")], 5).select("query_id", "memory_id")


def expand_terms(spark: SparkSession, folder: str) -> DataFrame:
    found = X.feedback_terms(_seeds(_fused(spark, folder)), P.search_queries(spark, folder), P.active(spark, folder))
    return found.select("query_id", "term", r6("weight").alias("weight"), F.col("rank").cast("int").alias("rank"))


def expand_by_terms(spark: SparkSession, folder: str) -> DataFrame:
    fused = _fused(spark, folder)
    found = X.by_feedback_terms(_seeds(fused), P.search_queries(spark, folder), P.active(spark, folder), fused)
    return found.select("query_id", "memory_id", r6("bm25").alias("bm25"), F.col("rank").cast("int").alias("rank"))


def expand_by_session(spark: SparkSession, folder: str) -> DataFrame:
    fused = _fused(spark, folder)
    return X.by_session(_seeds(fused), P.active(spark, folder), fused)


def expand_by_themes(spark: SparkSession, folder: str) -> DataFrame:
    fused = _fused(spark, folder)
    return X.by_theme_bridge(_seeds(fused), P.search_queries(spark, folder), P.active(spark, folder), fused).select("query_id", "memory_id", "shared", F.col("rank").cast("int").alias("rank"))


def expand_by_centroid(spark: SparkSession, folder: str) -> DataFrame:
    """The memories nearest to the mean vector of each query's first five."""
    vectors = first_vectors(table(spark, folder, "memory_vec"))
    mean = checkpoint(X.by_centroid(_seeds(_fused(spark, folder)), vectors))
    found = R.vector_channel(mean, vectors.select(F.col("memory_id").alias("id"), F.col("embedding").alias("vector")), k=10)
    return found.select("query_id", F.col("id").alias("memory_id"), F.round("distance", 5).alias("distance"))


def expand_by_rocchio(spark: SparkSession, folder: str) -> DataFrame:
    """The thirty memories nearest to each query's vector (the mean of its first keyword hits') moved toward its first five results."""
    vectors = table(spark, folder, "memory_vec")
    hits, fused = _found(spark, folder)
    moved = checkpoint(X.moved_vectors(hits, _seeds(fused), vectors))
    found = R.vector_channel(moved, vectors.where("memory_id is not null").select(F.col("memory_id").alias("id"), F.col("embedding").alias("vector")), k=30)
    return found.select("query_id", F.col("id").alias("memory_id"), F.round("distance", 5).alias("distance"))


def expand_by_word_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Memories beyond the pool by pairs of the query's words."""
    found = X.by_word_pairs(P.search_queries(spark, folder), P.active(spark, folder), _fused(spark, folder))
    return found.select("query_id", "memory_id", r6("score").alias("score"), F.col("rank").cast("int").alias("rank"))


def expand_by_links(spark: SparkSession, folder: str) -> DataFrame:
    """Active memories linked to a query's first five results and not in its pool, by how much they add to them."""
    live = P.active(spark, folder).select(F.col("id").alias("memory_id"))
    hits, fused = _found(spark, folder)
    found = X.by_links(hits, _seeds(fused), R.adjacency(table(spark, folder, "memory_edges")), table(spark, folder, "memory_vec"), fused, live)
    return found.withColumn("novelty", F.round("novelty", 5))


def expand_all(spark: SparkSession, folder: str) -> DataFrame:
    """What the expansions by terms, session, themes and word pairs add to each query's pool, and which of them did; all of one pool."""
    queries = checkpoint(P.search_queries(spark, folder))
    live = checkpoint(P.active(spark, folder).select("id", "summary", "themes", "session_id", "created_at"))
    pool = checkpoint(Q._fused_of(R.keyword_channel(queries, live), R.theme_channel(queries, live)).select("query_id", "memory_id", F.round("score", 9).alias("score")))
    seeds = checkpoint(_seeds(pool))
    return X.together({
        "pairs": X.by_word_pairs(queries, live, pool), "session": X.by_session(seeds, live, pool),
        "terms": X.by_feedback_terms(seeds, queries, live, pool), "themes": X.by_theme_bridge(seeds, queries, live, pool),
    })


QUERIES = {f.__name__: f for f in (expand_by_links, expand_all, expand_by_rocchio, expand_by_word_pairs, features, features_correlated, features_proximity, expand_terms, expand_by_terms, expand_by_session, expand_by_themes, expand_by_centroid)}

_R = "fz AS (SELECT query_id, memory_id, round(score, 9) AS score FROM fu)"
_SEEDS = "sd AS (SELECT query_id, memory_id FROM fz QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) <= 5)"
_BASE = (*Q._BASE, _R, _SEEDS)
_BURST = """bu AS (SELECT memory_id, CASE WHEN count(*) < 3 OR coalesce(avg(gap), 1) <= 0 THEN 0.0 ELSE var_pop(gap) / (avg(gap) * avg(gap)) - 1 END AS burstiness FROM (
  SELECT memory_id, (epoch_us(created_at) - lag(epoch_us(created_at)) OVER (PARTITION BY memory_id ORDER BY created_at, id)) / 1e6 AS gap FROM evt WHERE event_type = 'retrieved' AND created_at IS NOT NULL AND memory_id IS NOT NULL) GROUP BY memory_id)"""
_WT = f"list_distinct(list_filter(flatten(list_transform({P.NORMAL}, lambda t: string_split(lower(t), '-'))), lambda w: w <> ''))"

SQL = {
    "features": P.ctes(*_BASE, P.FB, P.NOW, SUMMARY, P.EVT, _BURST, Q._EDGES, "dg AS (SELECT m, count(*) AS links FROM (SELECT s AS m FROM ed WHERE s IS NOT NULL AND t IS NOT NULL UNION ALL SELECT t FROM ed WHERE s IS NOT NULL AND t IS NOT NULL) GROUP BY m)",
      f"a AS (SELECT query_id, list_distinct({P.WORDS.format('query')}) AS asked FROM qry)", f"o AS (SELECT *, list_distinct({P.WORDS.format('content')}) AS cw, {_WT} AS tw FROM act)")
    + """SELECT a.query_id, o.id AS memory_id, round(score, 6) AS score, kw.rank::DOUBLE AS keyword_rank, th.rank::DOUBLE AS theme_rank, len(list_intersect(asked, tw))::INTEGER AS theme_overlap,
      abs(kw.rank - th.rank)::DOUBLE AS rank_gap, round(cume_dist() OVER (PARTITION BY a.query_id ORDER BY score), 6) AS score_percentile,
      round(CASE WHEN len(asked) > 0 THEN len(list_intersect(asked, cw))::DOUBLE / len(asked) ELSE 0.0 END, 6) AS query_coverage, len(asked)::INTEGER AS query_length, count(*) OVER (PARTITION BY a.query_id) AS pool_size,
      list_position(['episodic', 'semantic', 'procedural', 'reflection', 'meta', 'entity'], category)::INTEGER AS category, base_priority AS priority, round((epoch_us(now) - epoch_us(created_at)) / 86400e6, 6) AS age_days,
      coalesce(token_count, 0) AS token_count, len(coalesce(themes, []))::INTEGER AS theme_count, round(coalesce(confidence, 0.5), 6) AS confidence,
      round(coalesce(decay_rate, CASE category WHEN 'entity' THEN 0.0 WHEN 'meta' THEN 0.004 WHEN 'reflection' THEN 0.006 WHEN 'semantic' THEN 0.008 WHEN 'procedural' THEN 0.012 WHEN 'episodic' THEN 0.023 END, 0.008)::DOUBLE, 6) AS decay_rate,
      coalesce(fb_count, 0) AS fb_count, round(fb_mean, 6) AS fb_mean, round(fb_last, 6) AS fb_last, round(fb_time_weighted, 6) AS fb_time_weighted, coalesce(links, 0) AS links, round(coalesce(burstiness, 0.0), 6) AS burstiness
      FROM fz JOIN a ON a.query_id = fz.query_id JOIN o ON o.id = fz.memory_id LEFT JOIN kw ON kw.query_id = fz.query_id AND kw.memory_id = fz.memory_id LEFT JOIN th ON th.query_id = fz.query_id AND th.memory_id = fz.memory_id
      LEFT JOIN sm ON sm.memory_id = o.id LEFT JOIN dg ON dg.m = o.id LEFT JOIN bu ON bu.memory_id = o.id, clock""",
    "expand_terms": P.ctes(*_BASE, f"w AS (SELECT id, {P.WORDS.format('summary')} AS w FROM act)", "d AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(w)) AS term FROM w) GROUP BY term)", "nn AS (SELECT count(*) AS n FROM act)",
      "t AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest(w) AS term FROM sd JOIN w ON w.id = sd.memory_id) WHERE length(term) >= 3 GROUP BY ALL)", f"ow AS (SELECT DISTINCT query_id, unnest({P.WORDS.format('query')}) AS term FROM qry)")
    + """SELECT query_id, term, round(wt, 6) AS weight, rank::INTEGER AS rank FROM (SELECT query_id, t.term, round(tf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1), 9) AS wt, row_number() OVER (PARTITION BY query_id ORDER BY round(tf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1), 9) DESC, t.term) - 1 AS rank
      FROM t JOIN d ON d.term = t.term, nn WHERE (query_id, t.term) NOT IN (SELECT query_id, term FROM ow)) WHERE rank < 10""",
    "expand_by_themes": P.ctes(*_BASE, f"tm AS (SELECT id, unnest({P.NORMAL}) AS theme FROM act)", f"nm AS (SELECT DISTINCT query_id, unnest({P.WORDS.format('query')}) AS theme FROM qry)", "br AS (SELECT DISTINCT query_id, theme FROM sd JOIN tm ON tm.id = sd.memory_id)")
    + """SELECT query_id, id AS memory_id, shared, rank::INTEGER AS rank FROM (SELECT query_id, id, count(*) AS shared, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, id) - 1 AS rank FROM br JOIN tm ON tm.theme = br.theme
      WHERE (query_id, br.theme) NOT IN (SELECT query_id, theme FROM nm) AND (query_id, id) NOT IN (SELECT query_id, memory_id FROM fz) GROUP BY query_id, id) WHERE rank < 30""",
}

_MEAN = """{n}i AS (SELECT query_id, i, avg(x) AS x FROM (SELECT query_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM {t} JOIN vc ON vc.memory_id = {t}.memory_id {w}) GROUP BY query_id, i),
{n} AS (SELECT query_id, list(x ORDER BY i) AS v FROM {n}i GROUP BY query_id)"""
_WORDS = P.WORDS.format("query")
_STOP = "['" + "', '".join(X.STOPWORDS) + "']"
SQL |= {
    "features_proximity": P.ctes(*_BASE, f"a AS (SELECT query_id, list_distinct({_WORDS}) AS asked FROM qry)", f"t AS (SELECT id, {P.WORDS.format('content')} AS tx FROM act)",
      "pp AS (SELECT fz.query_id, fz.memory_id, asked, tx FROM fz JOIN a ON a.query_id = fz.query_id JOIN t ON t.id = fz.memory_id)",
      "oc AS (SELECT query_id, memory_id, pos, word FROM (SELECT query_id, memory_id, asked, unnest(tx) AS word, generate_subscripts(tx, 1) AS pos FROM pp) WHERE list_contains(asked, word))",
      "la AS (SELECT x.query_id, x.memory_id, x.pos, y.word, max(y.pos) AS last FROM oc x JOIN oc y ON x.query_id = y.query_id AND x.memory_id = y.memory_id AND y.pos <= x.pos GROUP BY ALL)",
      "wi AS (SELECT query_id, memory_id, pos, pos - min(last) + 1 AS width, count(*) AS have FROM la GROUP BY query_id, memory_id, pos)")
    + "SELECT pp.query_id, pp.memory_id, round(coalesce(len(any_value(asked))::DOUBLE / min(width) FILTER (have = len(asked)), 0.0::DOUBLE), 6) AS proximity FROM pp LEFT JOIN wi ON wi.query_id = pp.query_id AND wi.memory_id = pp.memory_id GROUP BY pp.query_id, pp.memory_id",
    "expand_by_centroid": P.ctes(*_BASE, Q._VEC, _MEAN.format(n="ce", t="sd", w=""), "nn AS (SELECT query_id, memory_id, round(1 - list_cosine_similarity(v, e), 9) AS d FROM ce, vc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, memory_id) <= 10)")
    + "SELECT query_id, memory_id, round(d, 5) AS distance FROM nn",
    "expand_by_rocchio": P.ctes(*_BASE, Q._VEC, _MEAN.format(n="qv", t="kw", w="WHERE rank < 5"), _MEAN.format(n="ce", t="sd", w=""), """mv AS (SELECT qv.query_id, CASE WHEN ce.v IS NULL THEN qv.v ELSE list_transform(list_zip(qv.v, ce.v), lambda p: 0.7::DOUBLE * p[1] + 0.3::DOUBLE * p[2]) END AS v FROM qv LEFT JOIN ce ON ce.query_id = qv.query_id),
      nn AS (SELECT query_id, memory_id, round(1 - list_cosine_similarity(v, e), 9) AS d FROM mv, vc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, memory_id) <= 30)""") + "SELECT query_id, memory_id, round(d, 5) AS distance FROM nn",
    "expand_by_session": P.ctes(*_BASE, """se AS (SELECT query_id, sd.memory_id, session_id FROM sd JOIN act ON act.id = sd.memory_id WHERE session_id IS NOT NULL),
      ot AS (SELECT se.query_id, act.id AS other, row_number() OVER (PARTITION BY se.query_id, se.memory_id ORDER BY act.created_at DESC NULLS LAST, act.id) AS n FROM se JOIN act ON act.session_id = se.session_id AND act.id <> se.memory_id WHERE (se.query_id, act.id) NOT IN (SELECT query_id, memory_id FROM fz))""")
    + "SELECT DISTINCT query_id, other AS memory_id FROM ot WHERE n <= 5",
    "expand_by_word_pairs": P.ctes(*_BASE, f"sw AS (SELECT query_id, list_slice(list_filter({P.distinct_list('ws')}, lambda w: length(w) >= 3 AND NOT list_contains({_STOP}, w)), 1, 5) AS s FROM (SELECT query_id, {_WORDS} AS ws FROM qry))",
      "ij AS (SELECT query_id, i, j, s[i] AS a, s[j] AS b FROM sw, (SELECT unnest(range(1, 5)) AS i), (SELECT unnest(range(2, 6)) AS j) WHERE i < j AND j <= len(s) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i, j) <= 8)",
      "tt AS (SELECT query_id, i, j, unnest([a, b]) AS term FROM ij)",
      """hh AS (SELECT query_id, i, j, memory_id, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * (wtf * 2.2::DOUBLE / (wtf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avg_length)))), 9) AS bm25
        FROM tt JOIN dfs ON dfs.term = tt.term JOIN post ON post.term = tt.term, st GROUP BY ALL HAVING count(*) = 2)""",
      "rr AS (SELECT *, row_number() OVER (PARTITION BY query_id, i, j ORDER BY bm25 DESC, memory_id) - 1 AS rank FROM hh QUALIFY rank < 20)",
      "ss AS (SELECT query_id, memory_id, round(sum(1 / (60.0::DOUBLE + rank)), 9) AS score FROM rr WHERE (query_id, memory_id) NOT IN (SELECT query_id, memory_id FROM fz) GROUP BY ALL)")
    + "SELECT query_id, memory_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) - 1 AS rank FROM ss) WHERE rank < 30",
}
SQL["expand_by_terms"] = SQL["expand_terms"].replace("SELECT query_id, term, round(wt, 6) AS weight, rank::INTEGER AS rank FROM (", ", et AS (SELECT query_id, term FROM (") + f"""),
  eh AS (SELECT et.query_id, memory_id, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * (wtf * 2.2::DOUBLE / (wtf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avg_length)))), 9) AS bm25, count(*) AS m, any_value(nt) AS nt
    FROM (SELECT query_id, term, count(*) OVER (PARTITION BY query_id) AS nt FROM et) et JOIN dfs ON dfs.term = et.term JOIN post ON post.term = et.term, st WHERE (et.query_id, memory_id) NOT IN (SELECT query_id, memory_id FROM fz) GROUP BY et.query_id, memory_id)
  SELECT query_id, memory_id, round(bm25, 6) AS bm25, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, memory_id) - 1 AS rank FROM eh WHERE nt > 3 OR m = nt) WHERE rank < 30"""
_EACH = ", ".join(f"{{'a': '{a}', 'b': '{b}', 'c': corr({a}, {b})}}" for a, b in combinations(CORRELATED, 2))
SQL["features_correlated"] = f"SELECT u.a AS feature_a, u.b AS feature_b, CASE WHEN isnan(u.c) THEN NULL ELSE round(u.c, 6) END AS correlation FROM (SELECT unnest([{_EACH}]) AS u FROM ({SQL['features']}))"
SQL["expand_by_links"] = P.ctes(*_BASE, Q._VEC, Q._EDGES, Q._ADJ, _MEAN.format(n="qv", t="kw", w="WHERE rank < 5"),
  "nb AS (SELECT DISTINCT query_id, node, nxt FROM sd JOIN adj ON adj.node = sd.memory_id WHERE node <> nxt AND nxt IN (SELECT id FROM act) AND (query_id, nxt) NOT IN (SELECT query_id, memory_id FROM fz))",
  "vv AS (SELECT nb.query_id, nxt, q.v AS q, a.e AS s, b.e AS n, list_dot_product(b.e, a.e) / list_dot_product(a.e, a.e) AS share FROM nb JOIN qv q ON q.query_id = nb.query_id JOIN vc a ON a.memory_id = node JOIN vc b ON b.memory_id = nxt)",
  "re AS (SELECT query_id, nxt, q, list_transform(list_zip(n, s), lambda p: p[1] - share * p[2]) AS r FROM vv)",
) + """SELECT query_id, nxt AS memory_id, round(max(CASE WHEN sqrt(list_dot_product(r, r)) < 1e-8 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, list_cosine_similarity(q, r))) END), 5) AS novelty FROM re GROUP BY query_id, nxt"""
SQL["expand_all"] = "SELECT query_id, memory_id, string_agg(method, '+' ORDER BY method) AS methods FROM (" + " UNION ALL ".join(f"SELECT DISTINCT query_id, memory_id, '{name}' AS method FROM ({SQL[query]})" for name, query in (("pairs", "expand_by_word_pairs"), ("session", "expand_by_session"), ("terms", "expand_by_terms"), ("themes", "expand_by_themes"))) + ") GROUP BY query_id, memory_id"
