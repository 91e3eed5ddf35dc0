"""Queries that search: channels, fusion, re-scoring, and the links between memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.config import SCORING
from mnemospark.operators import graph as G
from mnemospark.operators import retrieval as R
from mnemospark.operators.arrivals import arrival_outcomes
from mnemospark.operators.feedback import beta_prior, feedback_summary
from mnemospark.plans import parts as P
from mnemospark.plans.feedback_queries import MATCHED, PRIOR, SUMMARY, matched
from mnemospark.plans.parts import r6
from mnemospark.runtime import checkpoint
from mnemospark.sources.tables import table


def _channels(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    queries, live = checkpoint(P.search_queries(spark, folder)), checkpoint(P.active(spark, folder).select("id", "summary", "themes"))
    return R.keyword_channel(queries, live), R.theme_channel(queries, live)


def search_keywords(spark: SparkSession, folder: str) -> DataFrame:
    found, _ = _channels(spark, folder)
    return found.select("query_id", "memory_id", r6("bm25").alias("bm25"), F.col("rank").cast("int").alias("rank"))


def search_themes(spark: SparkSession, folder: str) -> DataFrame:
    _, found = _channels(spark, folder)
    return found.select("query_id", "memory_id", "overlap", F.col("rank").cast("int").alias("rank"))


def search_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return R.phrase_channel(P.search_queries(spark, folder), P.active(spark, folder))


def search_idf(spark: SparkSession, folder: str) -> DataFrame:
    """Per query: number of known words, and mean and variance of their rarity."""
    live = P.active(spark, folder)
    df = R.postings(live).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = live.agg(F.count(F.lit(1)).alias("n"))
    idf = df.crossJoin(F.broadcast(n)).select("term", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))  # n is one row
    per = R.query_terms(P.search_queries(spark, folder)).join(idf, "term").groupBy("query_id")
    return per.agg(F.count(F.lit(1)).alias("terms"), r6(F.avg("idf")).alias("idf_mean"), r6(F.var_pop("idf")).alias("idf_var"))


def search_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest of every hundredth vector, among all."""
    vectors = table(spark, folder, "embeddings").where("vec_id is not null")
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = R.vector_channel(queries, vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), k=10)
    return found.select("query_id", F.col("id").alias("vec_id"), r6("distance").alias("distance"), F.col("rank").cast("int").alias("rank"))


def _fused_of(keywords: DataFrame, themes: DataFrame) -> DataFrame:
    return R.fuse({"keyword": (keywords, SCORING.keyword_k, SCORING.keyword_weight), "theme": (themes, SCORING.theme_k, SCORING.theme_weight)})


def _fused(spark: SparkSession, folder: str) -> DataFrame:
    return _fused_of(*_channels(spark, folder))


def recall_fused(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best memories of each query by fused ranks of keywords and themes."""
    best = R.top_k(_fused(spark, folder).withColumn("score", F.round("score", 9)), "query_id", [F.desc("score"), F.col("memory_id")], 10)
    return best.select("query_id", "memory_id", r6("score").alias("score"), F.col("rank").cast("int").alias("rank"))


def _explored(spark: SparkSession, folder: str) -> DataFrame:
    ratings = P.feedback(spark, folder)
    timed = ratings.crossJoin(F.broadcast(P.now(spark, folder)))  # one row
    return R.with_exploration(_fused(spark, folder), feedback_summary(timed, F.col("now")), beta_prior(ratings))


def recall_explored(spark: SparkSession, folder: str) -> DataFrame:
    """As above, with the bonus for what feedback knows little of."""
    best = R.top_k(_explored(spark, folder).withColumn("score", F.round("score", 9)), "query_id", [F.desc("score"), F.col("memory_id")], 10)
    return best.select("query_id", "memory_id", r6("score").alias("score"), F.col("rank").cast("int").alias("rank"))


def _seen(spark: SparkSession, folder: str) -> DataFrame:
    return R.co_retrieval(P.events(spark, folder, "event_type = 'retrieved'"))


def recall_hebbian(spark: SparkSession, folder: str) -> DataFrame:
    """As above, with the bonus for having been returned together with the best."""
    explored = checkpoint(_explored(spark, folder).withColumn("score", F.round("score", 9)))
    best = R.top_k(R.with_hebbian(explored, _seen(spark, folder)).withColumn("score", F.round("score", 9)), "query_id", [F.desc("score"), F.col("memory_id")], 10)
    return best.select("query_id", "memory_id", r6("score").alias("score"), F.col("rank").cast("int").alias("rank"))


def _recalled(spark: SparkSession, folder: str) -> DataFrame:
    explored = checkpoint(_explored(spark, folder).withColumn("score", F.round("score", 9)))
    scored = checkpoint(R.with_hebbian(explored, _seen(spark, folder)).select("query_id", "memory_id", F.round("score", 9).alias("score")))
    live = P.active(spark, folder)
    return R.with_expansion(scored, R.adjacency(table(spark, folder, "memory_edges")), live.select(F.col("id").alias("memory_id")))


def recall_full(spark: SparkSession, folder: str) -> DataFrame:
    """The whole pipeline: channels, fusion, exploration, co-retrieval, spreading activation, limit and token budget."""
    best = R.top_k(_recalled(spark, folder), "query_id", [F.desc("score"), F.col("memory_id")], 20)
    tokens = P.active(spark, folder).select(F.col("id").alias("memory_id"), F.coalesce("token_count", F.lit(0)).alias("tokens"))
    shown = R.within_budget(best.join(tokens, "memory_id"), 500)
    return shown.select("query_id", "memory_id", r6("score").alias("score"), F.col("rank").cast("int").alias("rank"), "used")


def recall_contradictions(spark: SparkSession, folder: str) -> DataFrame:
    """Results of one query that a link says contradict each other."""
    return R.contradictions(_fused(spark, folder), table(spark, folder, "memory_edges"))


def activation_spread(spark: SparkSession, folder: str) -> DataFrame:
    """Activation from the links of the first memory of each topic by id, two hops far."""
    topics = P.active(spark, folder).where("topic_id is not null").select(F.col("id").alias("memory_id"), "topic_id")
    seeds = topics.groupBy(F.col("topic_id").alias("query_id")).agg(F.min("memory_id").alias("memory_id")).withColumn("score", F.lit(1.0))
    return R.spread_activation(seeds, R.adjacency(table(spark, folder, "memory_edges"))).select(F.col("query_id").alias("topic_id"), F.col("node").alias("memory_id"), r6("ppr").alias("ppr")).where("ppr > 0")


def link_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return G.degrees(table(spark, folder, "memory_edges"))


def link_two_hops(spark: SparkSession, folder: str) -> DataFrame:
    """What the summaries of the store reach over two links, counted by distance."""
    seeds = P.active(spark, folder).where("layer = 'gestalt'").select(F.col("id").alias("memory_id"))
    return G.two_hops(seeds, table(spark, folder, "memory_edges")).groupBy("seed", "hops").agg(F.count(F.lit(1)).alias("nodes"))


def link_dangling(spark: SparkSession, folder: str) -> DataFrame:
    return G.dangling(table(spark, folder, "memory_edges"), table(spark, folder, "memories"))


def link_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Memories that one recall returned and that were both found useful, and are not linked yet."""
    good = matched(spark, folder).where("utility >= 0.5").select("recall_id", "memory_id").distinct()
    pairs = good.withColumnRenamed("memory_id", "a").join(good.withColumnRenamed("memory_id", "b"), "recall_id").where("a < b").select("a", "b")
    return G.new_links(pairs, table(spark, folder, "memory_edges"))


def _cosines(spark: SparkSession, folder: str) -> DataFrame:
    return G.linked_cosines(table(spark, folder, "memory_edges"), table(spark, folder, "memory_vec"))


def link_cosines(spark: SparkSession, folder: str) -> DataFrame:
    return _cosines(spark, folder).select("low", "high", F.round("cosine", 5).alias("cosine"))


def link_diversity(spark: SparkSession, folder: str) -> DataFrame:
    return G.diversity(_cosines(spark, folder)).select("memory_id", F.round("diversity", 5).alias("diversity"))


def link_shadows(spark: SparkSession, folder: str) -> DataFrame:
    return G.shadow_load(P.memories(spark, folder), table(spark, folder, "memory_vec")).select("memory_id", F.round("shadow", 5).alias("shadow"))


def link_betweenness(spark: SparkSession, folder: str) -> DataFrame:
    """Shortest paths through each active memory, from a stated set of sources: every hundredth active memory by the hash of its id."""
    live = P.active(spark, folder).select(F.col("id").alias("memory_id"))
    sources = live.where(F.pmod(F.xxhash64("memory_id"), F.lit(100)) == 0)
    return G.betweenness(table(spark, folder, "memory_edges"), sources, live).select("memory_id", F.round("betweenness", 12).alias("betweenness"))


def vectors_unindexed(spark: SparkSession, folder: str) -> DataFrame:
    """Index hygiene: vectors without a live memory, and live memories without a usable vector."""
    live = P.memories(spark, folder).where("status <> 'deleted'").select(F.col("id").alias("memory_id"))
    held = table(spark, folder, "memory_vec").where("memory_id is not null").select("memory_id").distinct()
    usable = G.first_vectors(table(spark, folder, "memory_vec")).select("memory_id")
    gone = held.join(live, "memory_id", "left_anti").withColumn("problem", F.lit("no_memory"))
    return gone.unionByName(live.join(usable, "memory_id", "left_anti").withColumn("problem", F.lit("no_vector")))


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """What becomes of each active memory as it arrives, held against all that came before it."""
    found = arrival_outcomes(P.active(spark, folder), G.first_vectors(table(spark, folder, "memory_vec")))
    return found.select("id", "outcome", "other", F.round("distance", 5).alias("distance"))


QUERIES = {f.__name__: f for f in (
    arrivals, search_keywords, search_themes, search_phrases, search_idf, search_vectors, recall_fused, recall_explored, recall_hebbian, recall_full, recall_contradictions, activation_spread,
    link_degrees, link_two_hops, link_dangling, link_candidates, link_cosines, link_diversity, link_shadows, link_betweenness, vectors_unindexed,
)}

_S, _T = P.WORDS.format("coalesce(summary, '')"), P.WORDS.format("coalesce(array_to_string(themes, ' '), '')")
_TERMS = f"qt AS (SELECT query_id, unnest(t) AS term, len(t) AS n_terms FROM (SELECT query_id, list_distinct(list_filter({P.WORDS.format('query')}, lambda w: length(w) > 1)) AS t FROM qry))"
_INDEX = f"""pw AS (SELECT id, unnest({_S}) AS term, 13.278::DOUBLE AS w, len({_S}) + len({_T}) AS length FROM act UNION ALL SELECT id, unnest({_T}), 5.731::DOUBLE, len({_S}) + len({_T}) FROM act),
post AS (SELECT term, id AS memory_id, sum(w) AS wtf, any_value(length) AS length FROM pw GROUP BY term, id),
st AS (SELECT count(*) AS n, avg(len({_S}) + len({_T})) AS avg_length FROM act),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""
_KEYWORDS = """kw AS (SELECT query_id, memory_id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, memory_id) - 1 AS rank FROM (
  SELECT query_id, memory_id, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * (wtf * 2.2::DOUBLE / (wtf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / avg_length)))), 9) AS bm25, count(*) AS m, any_value(n_terms) AS nt
  FROM qt JOIN dfs ON qt.term = dfs.term JOIN post ON post.term = qt.term, st GROUP BY query_id, memory_id) WHERE nt > 3 OR m = nt QUALIFY rank < 150)"""
_THEMES = f"""tw AS (SELECT DISTINCT id AS memory_id, unnest(list_filter(flatten(list_transform({P.NORMAL}, lambda t: string_split(lower(t), '-'))), lambda w: w <> '')) AS term FROM act),
th AS (SELECT query_id, memory_id, overlap, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, memory_id) - 1 AS rank FROM (
  SELECT query_id, memory_id, count(*) AS overlap FROM qt JOIN tw ON qt.term = tw.term GROUP BY query_id, memory_id) QUALIFY rank < 150)"""
_FUSED = """fu AS (SELECT query_id, memory_id, sum(p) AS score FROM (SELECT query_id, memory_id, 0.495::DOUBLE / (8.002::DOUBLE + rank + 1) AS p FROM kw
  UNION ALL SELECT query_id, memory_id, 0.116::DOUBLE / (4.924::DOUBLE + rank + 1) FROM th) GROUP BY query_id, memory_id)"""
_BASE = (P.MEM, P.REC, P.QRY, _TERMS, _INDEX, _KEYWORDS, _THEMES, _FUSED)
_EXPLORED = """ex AS (SELECT query_id, memory_id, round(score * (1 + 0.84::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))), 9) AS score FROM (
  SELECT query_id, memory_id, score, coalesce(fb_ewma, 0.0::DOUBLE) * ess + prior_mean * prior_strength AS a, (1 - coalesce(fb_ewma, 0.0::DOUBLE)) * ess + (1 - prior_mean) * prior_strength AS b FROM (
    SELECT query_id, fu.memory_id, score, fb_ewma, CASE WHEN fb_count IS NULL THEN 0.0::DOUBLE ELSE least(fb_count::DOUBLE, 1 / (2 * 0.431::DOUBLE - 0.431::DOUBLE * 0.431::DOUBLE)) END AS ess FROM fu LEFT JOIN sm ON sm.memory_id = fu.memory_id), prior))"""
_HEBBIAN = """seen AS (SELECT DISTINCT memory_id, query FROM memory_events WHERE event_type = 'retrieved' AND id IS NOT NULL AND memory_id IS NOT NULL AND query IS NOT NULL),
tq AS (SELECT count(DISTINCT query) AS total FROM seen), cn AS (SELECT memory_id, count(*) AS n FROM seen GROUP BY memory_id),
sd AS (SELECT query_id, memory_id AS seed FROM ex QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) <= 5),
ca AS (SELECT query_id, memory_id FROM ex WHERE (query_id, memory_id) NOT IN (SELECT query_id, seed FROM sd)),
jn AS (SELECT a.memory_id AS seed, b.memory_id, count(*) AS joint FROM seen a JOIN seen b ON a.query = b.query GROUP BY a.memory_id, b.memory_id HAVING count(*) >= 2),
bo AS (SELECT query_id, ca.memory_id, least(0.275::DOUBLE, sum(least(0.275::DOUBLE, greatest(0.0::DOUBLE, 0.001746::DOUBLE * log2(joint * total / (c1.n::DOUBLE * c2.n)))))) AS boost
  FROM ca JOIN sd USING (query_id) JOIN jn ON jn.seed = sd.seed AND jn.memory_id = ca.memory_id JOIN cn c1 ON c1.memory_id = ca.memory_id JOIN cn c2 ON c2.memory_id = sd.seed, tq WHERE total >= 5 GROUP BY query_id, ca.memory_id),
he AS (SELECT ex.query_id, ex.memory_id, round(score + coalesce(boost, 0.0::DOUBLE), 9) AS score FROM ex LEFT JOIN bo ON bo.query_id = ex.query_id AND bo.memory_id = ex.memory_id)"""
_EDGES = "ed AS (SELECT id, any_value(source_id) AS s, any_value(target_id) AS t, any_value(weight) AS w, any_value(flags) AS flags FROM memory_edges WHERE id IS NOT NULL GROUP BY id)"
_ADJ = """adj AS (SELECT s AS node, t AS nxt, coalesce(w, 1.0::DOUBLE) AS w FROM ed WHERE s IS NOT NULL AND t IS NOT NULL AND NOT coalesce(list_contains(flags, 'contradiction'), false)
  UNION ALL SELECT t, s, coalesce(w, 1.0::DOUBLE) FROM ed WHERE s IS NOT NULL AND t IS NOT NULL AND NOT coalesce(list_contains(flags, 'contradiction'), false))"""


def _ppr(seeds: str) -> str:
    """Twelve steps from the table of ``seeds`` (q, node, score), one after the other."""
    steps = ["p0 AS (SELECT q, node, seed AS p FROM s0)"]
    for i in range(1, 13):
        steps.append(f"p{i} AS (SELECT q, node, sum(p) AS p FROM (SELECT x.q, l.nxt AS node, 0.216::DOUBLE * x.p * l.share AS p FROM p{i - 1} x JOIN ln l ON l.q = x.q AND l.node = x.node UNION ALL SELECT q, node, (1 - 0.216::DOUBLE) * seed FROM s0) GROUP BY q, node)")
    return f"""s0 AS (SELECT q, node, score / sum(score) OVER (PARTITION BY q) AS seed FROM {seeds}),
nr AS (SELECT q, node FROM s0 UNION SELECT q, nxt FROM s0 JOIN adj USING (node)),
o1 AS (SELECT q, adj.node, nxt, w FROM nr JOIN adj ON adj.node = nr.node),
lk AS (SELECT q, node, nxt, w FROM o1 UNION ALL SELECT q, nxt, node, w FROM o1 WHERE (q, nxt) NOT IN (SELECT q, node FROM nr)),
ln AS MATERIALIZED (SELECT q, node, nxt, w / sum(w) OVER (PARTITION BY q, node) AS share FROM lk), """ + ", ".join(steps).replace(" AS (SELECT q, node, sum", " AS MATERIALIZED (SELECT q, node, sum")


_TOP10 = "SELECT query_id, memory_id, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT query_id, memory_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) - 1 AS rank FROM {}) WHERE rank < 10"
_PAIRS = "pr AS (SELECT DISTINCT least(source_id, target_id) AS low, greatest(source_id, target_id) AS high FROM memory_edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL AND source_id <> target_id)"
_COS = """vc AS (SELECT memory_id, any_value(embedding) AS e FROM memory_vec WHERE len(embedding) = 384 AND memory_id IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY memory_id),
co AS (SELECT low, high, list_cosine_similarity(a.e::DOUBLE[], b.e::DOUBLE[]) AS cosine FROM pr JOIN vc a ON a.memory_id = low JOIN vc b ON b.memory_id = high)"""

_VEC = "vc AS (SELECT memory_id, any_value(embedding)::DOUBLE[] AS e FROM memory_vec WHERE len(embedding) = 384 AND memory_id IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY memory_id)"

SQL = {
    "arrivals": P.ctes(P.MEM, _VEC, """k AS (SELECT w.id, min((round(1 - list_cosine_similarity(x.e, y.e), 9), a.id, w.base_priority, a.base_priority)) AS n FROM act w JOIN vc x ON x.memory_id = w.id
      JOIN act a ON a.category = w.category AND a.created_at < w.created_at JOIN vc y ON y.memory_id = a.id GROUP BY w.id)""")
    + """SELECT act.id, CASE WHEN n[1] < 0.1 AND n[3] > n[4] THEN 'superseded' WHEN n[1] < 0.1 THEN 'dedup_rejected' ELSE 'inserted' END AS outcome, n[2] AS other, round(n[1], 5) AS distance FROM act LEFT JOIN k ON k.id = act.id""",
    "search_keywords": P.ctes(P.MEM, P.REC, P.QRY, _TERMS, _INDEX, _KEYWORDS) + "SELECT query_id, memory_id, round(bm25, 6) AS bm25, rank::INTEGER AS rank FROM kw",
    "search_themes": P.ctes(P.MEM, P.REC, P.QRY, _TERMS, _THEMES) + "SELECT query_id, memory_id, overlap, rank::INTEGER AS rank FROM th",
    "search_phrases": P.ctes(P.MEM, P.REC, P.QRY, f"w AS (SELECT id, {P.WORDS.format('content')} AS w FROM act WHERE content IS NOT NULL)", f"q AS (SELECT query_id, {P.WORDS.format('query')} AS w FROM qry)")
    + """SELECT query_id, id AS memory_id, (list_min(list_filter(range(1, len(w.w) - len(q.w) + 2), lambda i: w.w[i:i + len(q.w) - 1] = q.w)) - 1)::INTEGER AS at FROM q, w
      WHERE len(q.w) >= 2 AND len(list_filter(range(1, len(w.w) - len(q.w) + 2), lambda i: w.w[i:i + len(q.w) - 1] = q.w)) > 0""",
    "search_idf": P.ctes(P.MEM, P.REC, P.QRY, _TERMS, _INDEX) + "SELECT query_id, count(*) AS terms, round(avg(ln((n + 1) / (df + 1))), 6) AS idf_mean, round(var_pop(ln((n + 1) / (df + 1))), 6) AS idf_var FROM qt JOIN dfs ON qt.term = dfs.term, st GROUP BY query_id",
    "search_vectors": """SELECT query_id, vec_id, round(d, 6) AS distance, rank::INTEGER AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, d, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(d, 9), v.vec_id) - 1 AS rank FROM (
      SELECT a.vec_id AS qid, b.vec_id AS vid, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0) x JOIN embeddings q ON q.vec_id = qid JOIN embeddings v ON v.vec_id = vid) WHERE rank < 10""",
    "recall_fused": P.ctes(*_BASE, "r AS (SELECT query_id, memory_id, round(score, 9) AS score FROM fu)") + _TOP10.format("r"),
    "recall_explored": P.ctes(*_BASE, P.FB, P.NOW, SUMMARY, PRIOR, _EXPLORED) + _TOP10.format("ex"),
    "recall_hebbian": P.ctes(*_BASE, P.FB, P.NOW, SUMMARY, PRIOR, _EXPLORED, _HEBBIAN) + _TOP10.format("he"),
    "recall_contradictions": P.ctes(*_BASE, "c AS (SELECT DISTINCT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM memory_edges WHERE list_contains(flags, 'contradiction') AND source_id <> target_id)")
    + "SELECT x.query_id, a AS memory_a, b AS memory_b FROM c JOIN fu x ON x.memory_id = a JOIN fu y ON y.memory_id = b AND x.query_id = y.query_id",
    "recall_full": P.ctes(*_BASE, P.FB, P.NOW, SUMMARY, PRIOR, _EXPLORED, _HEBBIAN, _EDGES, _ADJ, "sq AS (SELECT query_id AS q, memory_id AS node, score FROM he QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) <= 5)", _ppr("sq"), """
      sp AS (SELECT q AS query_id, node AS memory_id, p FROM p12 WHERE (q, node) NOT IN (SELECT q, node FROM sq)),
      nw AS (SELECT query_id, memory_id, p FROM sp WHERE (query_id, memory_id) NOT IN (SELECT query_id, memory_id FROM he) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(p, 12) DESC, memory_id) <= 20),
      rs AS (SELECT he.query_id, he.memory_id, score + coalesce(1.591::DOUBLE * p, 0.0::DOUBLE) AS score FROM he LEFT JOIN sp ON sp.query_id = he.query_id AND sp.memory_id = he.memory_id
        UNION ALL SELECT query_id, memory_id, 1.591::DOUBLE * p FROM nw WHERE memory_id IN (SELECT id FROM act)),
      rk AS (SELECT query_id, memory_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) - 1 AS rank FROM rs QUALIFY rank < 20)""")
    + "SELECT query_id, memory_id, round(score, 6) AS score, rank::INTEGER AS rank, used::BIGINT AS used FROM (SELECT rk.*, sum(coalesce(token_count, 0)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM rk JOIN act ON act.id = rk.memory_id) WHERE used <= 500",
    "activation_spread": P.ctes(P.MEM, _EDGES, _ADJ, "sq AS (SELECT topic_id AS q, min(id) AS node, 1.0::DOUBLE AS score FROM act WHERE topic_id IS NOT NULL GROUP BY topic_id)", _ppr("sq"))
    + "SELECT q AS topic_id, node AS memory_id, round(p, 6) AS ppr FROM p12 WHERE round(p, 6) > 0",
    "link_degrees": P.ctes(_EDGES, "b AS (SELECT s AS m, t AS o FROM ed WHERE s IS NOT NULL AND t IS NOT NULL UNION ALL SELECT t, s FROM ed WHERE s IS NOT NULL AND t IS NOT NULL)") + "SELECT m AS memory_id, count(*) AS links, count(DISTINCT CASE WHEN o <> m THEN o END) AS neighbours FROM b GROUP BY m",
    "link_two_hops": P.ctes(P.MEM, _PAIRS, "b AS (SELECT low AS n, high AS o FROM pr UNION ALL SELECT high, low FROM pr)", "h1 AS (SELECT DISTINCT id AS seed, o AS node FROM act JOIN b ON b.n = act.id WHERE layer = 'gestalt')")
    + "SELECT seed, hops::INTEGER AS hops, count(*) AS nodes FROM (SELECT seed, node, min(hops) AS hops FROM (SELECT seed, node, 1 AS hops FROM h1 UNION ALL SELECT seed, o, 2 FROM h1 JOIN b ON b.n = h1.node WHERE o <> seed) GROUP BY seed, node) GROUP BY seed, hops",
    "link_dangling": P.ctes(_EDGES) + """SELECT id, missing FROM (SELECT id, CASE WHEN s IS NULL OR t IS NULL THEN 'null_end' WHEN s NOT IN (SELECT id FROM memories WHERE id IS NOT NULL) AND t NOT IN (SELECT id FROM memories WHERE id IS NOT NULL) THEN 'both'
      WHEN s NOT IN (SELECT id FROM memories WHERE id IS NOT NULL) THEN 'source' WHEN t NOT IN (SELECT id FROM memories WHERE id IS NOT NULL) THEN 'target' END AS missing FROM ed) WHERE missing IS NOT NULL""",
    "link_cosines": P.ctes(_PAIRS, _COS) + "SELECT low, high, round(cosine, 5) AS cosine FROM co",
    "link_diversity": P.ctes(_PAIRS, _COS) + "SELECT m AS memory_id, round(1 - avg(cosine), 5) AS diversity FROM (SELECT low AS m, cosine FROM co UNION ALL SELECT high, cosine FROM co) GROUP BY m",
    "link_shadows": P.ctes(P.MEM, _VEC, "n AS (SELECT x.id, max(list_cosine_similarity(a.e, b.e)) AS c FROM mem x JOIN vc a ON a.memory_id = x.id JOIN mem y ON y.created_at > x.created_at JOIN vc b ON b.memory_id = y.id GROUP BY x.id)")
    + "SELECT memory_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (coalesce(c, 0.0::DOUBLE) - 0.7::DOUBLE) / 0.25::DOUBLE)), 5) AS shadow FROM vc JOIN mem ON mem.id = memory_id LEFT JOIN n ON n.id = memory_id",
    "vectors_unindexed": P.ctes(P.MEM) + """SELECT memory_id, 'no_memory' AS problem FROM (SELECT DISTINCT memory_id FROM memory_vec WHERE memory_id IS NOT NULL) WHERE memory_id NOT IN (SELECT id FROM mem WHERE status <> 'deleted')
      UNION ALL SELECT id, 'no_vector' FROM mem WHERE status <> 'deleted' AND id NOT IN (SELECT memory_id FROM memory_vec WHERE memory_id IS NOT NULL AND len(embedding) = 384 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)""",
}
SQL["link_candidates"] = P.ctes(P.FB, P.REC, MATCHED, _PAIRS, "g AS (SELECT DISTINCT recall_id, memory_id FROM ma WHERE utility >= 0.5)") + (
    "SELECT DISTINCT a.memory_id AS a, b.memory_id AS b FROM g a JOIN g b ON a.recall_id = b.recall_id AND a.memory_id < b.memory_id WHERE (a.memory_id, b.memory_id) NOT IN (SELECT low, high FROM pr)"
)
