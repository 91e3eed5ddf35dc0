"""Batch retrieval: for many queries at once, ranked candidates from keywords, themes and vectors, fused and re-scored.

Every stage is a table keyed by (query_id, memory_id). Channels give 0-based ranks; ties end with the id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.config import SCORING, Scoring
from mnemospark.functions.scores import exploration, reciprocal_rank
from mnemospark.functions.text import theme_words, words
from mnemospark.operators.search import best_in_cells, by_cosine, by_terms, with_packed
from mnemospark.runtime import checkpoint

#: Shares of the memories and of the queries in searches by words.
TERM_CELLS = 8, 4
#: Up to this many terms all must occur; of more, any.
ALL_TERMS = 3


def top_k(df: DataFrame, by: str, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their 0-based rank; Spark cuts each map task's share to k rows, too."""
    numbered = df.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1)
    return numbered.where(F.col(rank) < k)


def postings(memories: DataFrame, params: Scoring = SCORING) -> DataFrame:
    """(term, memory_id, wtf, length): weighted term frequency over summary and themes, and the memory's word count."""
    fields = memories.select("id", words(F.col("summary")).alias("s"), words(F.array_join(F.coalesce("themes", F.array().cast("array<string>")), " ")).alias("t"))
    sized = fields.withColumn("length", F.size("s") + F.size("t"))
    each = sized.select(F.col("id").alias("memory_id"), "length", F.explode(F.concat(F.transform("s", lambda w: F.struct(w.alias("term"), F.lit(params.summary_weight).alias("w"))), F.transform("t", lambda w: F.struct(w.alias("term"), F.lit(params.themes_weight).alias("w"))))).alias("x"))
    return each.groupBy(F.col("x.term").alias("term"), "memory_id").agg(F.sum("x.w").alias("wtf"), F.first("length").alias("length"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, n_terms): distinct words of two letters or more."""
    listed = queries.select("query_id", F.array_distinct(F.filter(words(F.col("query")), lambda w: F.length(w) > 1)).alias("terms"))
    return listed.select("query_id", F.explode("terms").alias("term"), F.size("terms").alias("n_terms"))


def keyword_channel(queries: DataFrame, memories: DataFrame, k: int = 150, params: Scoring = SCORING, without: DataFrame | None = None) -> DataFrame:
    """(query_id, memory_id, bm25, rank) by BM25 over summary and themes. A query without words finds nothing.

    What ``without`` (query_id, memory_id) lists is left out before the first k are taken.

    Memories and queries are dealt to cells, and a query's matches are summed where they lie: the work is that of the posting lists
    that queries ask for, and only the k best of a cell are shuffled. Ids are distinct.
    """
    text = memories.select("id", F.concat_ws(" ", words(F.col("summary"))).alias("first"), F.concat_ws(" ", words(F.array_join(F.coalesce("themes", F.array().cast("array<string>")), " "))).alias("second"))
    said = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    stats = text.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(said("first")) + F.size(said("second"))).alias("mean"))
    df = text.select(F.explode(F.array_distinct(F.concat(said("first"), said("second")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = query_terms(queries).join(df, "term").crossJoin(F.broadcast(stats)).select("query_id", "term", "n_terms", "mean", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))  # stats is one row
    asked = idf.groupBy("query_id", "n_terms", "mean").agg(F.array_sort(F.collect_list(F.struct("term", "idf"))).alias("t"))  # words of one query
    asked = asked.select("query_id", F.array_join("t.term", " ").alias("terms"), F.col("t.idf").alias("weights"), "n_terms", "mean", F.lit(ALL_TERMS).alias("all_terms"))
    pool = without if without is None else without.select("query_id", F.col("memory_id").alias("id"))
    found = best_in_cells(asked, text, by_terms(params.summary_weight, params.themes_weight, params.bm25_k1, params.bm25_b), k, *TERM_CELLS, without=pool)
    return top_k(found.select("query_id", F.col("id").alias("memory_id"), F.col("score").alias("bm25")), "query_id", [F.desc("bm25"), F.col("memory_id")], k)


def theme_channel(queries: DataFrame, memories: DataFrame, k: int = 150) -> DataFrame:
    """(query_id, memory_id, overlap, rank) by the number of query words among the words of a memory's themes."""
    text = memories.select("id", F.concat_ws(" ", theme_words(F.col("themes"))).alias("first"), F.lit("").alias("second"))
    listed = query_terms(queries).groupBy("query_id").agg(F.sort_array(F.collect_list("term")).alias("t"))  # words of one query
    asked = listed.select("query_id", F.array_join("t", " ").alias("terms"), F.transform("t", lambda _: F.lit(1.0)).alias("weights"), F.size("t").alias("n_terms"), F.lit(1.0).alias("mean"), F.lit(0).alias("all_terms"))
    found = best_in_cells(asked, text, by_terms(1.0, 1.0), k, *TERM_CELLS)
    return top_k(found.select("query_id", F.col("id").alias("memory_id"), F.col("score").cast("long").alias("overlap")), "query_id", [F.desc("overlap"), F.col("memory_id")], k)


def phrase_channel(queries: DataFrame, memories: DataFrame) -> DataFrame:
    """(query_id, memory_id, at): memories whose content has the query's words next to each other and in order.

    Adjacent words are looked up as pairs: the first pair finds the places, and each place must have all the others.
    Queries of fewer than two words find nothing.
    """
    asked = queries.select("query_id", words(F.col("query")).alias("w")).where(F.size("w") >= 2)
    pairs = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.concat_ws(" ", F.element_at(c, i), F.element_at(c, i + 1)))
    wanted = asked.select("query_id", F.posexplode(pairs("w")).alias("i", "pair"), (F.size("w") - 1).alias("n"))
    content = memories.select(F.col("id").alias("memory_id"), words(F.col("content")).alias("w")).where(F.size("w") >= 2)
    there = content.select("memory_id", F.posexplode(pairs("w")).alias("pos", "pair"))
    runs = wanted.join(there, "pair").groupBy("query_id", "memory_id", (F.col("pos") - F.col("i")).alias("at")).agg(F.count_distinct("i").alias("found"), F.first("n").alias("n"))
    return runs.where("found = n").groupBy("query_id", "memory_id").agg(F.min("at").cast("int").alias("at"))


def vector_channel(queries: DataFrame, vectors: DataFrame, k: int = 200, salts: int = 16, among: DataFrame | None = None) -> DataFrame:
    """(query_id, id, distance, rank): the k vectors (id, vector) nearest by cosine to each query (query_id, vector), or (query_id, packed) where they are packed already.

    A stated set of queries against all rows: rows are dealt out to ``salts`` groups, each of which gets all the queries, and
    k rows a query leave it, so that the work is spread and no pair is shuffled. Vectors are sent in the shortest kind of number that loses nothing, and
    what single precision finds is settled in double. Rows of one id are copies, of which one counts; with ``among`` (id) only ids listed there take part.
    Null and zero vectors don't take part, nor do those with a null or a non-finite number in them, and a query meets only vectors of its length.
    """
    asked = queries.select("query_id", "packed") if "packed" in queries.columns else with_packed(queries.select("query_id", "vector"), "query_id")
    rows = with_packed(vectors.select("id", "vector"), "id")
    found = best_in_cells(asked, rows, by_cosine, k, salts, 1, among=among).select("query_id", "id", (F.lit(0.0) - F.col("score")).alias("distance"))
    return top_k(found, "query_id", [F.col("distance"), F.col("id")], k)


def fuse(channels: dict[str, tuple[DataFrame, float, float]]) -> DataFrame:
    """(query_id, memory_id, score) and each channel's rank, from channel -> (ranks, k, weight): summed reciprocal ranks."""
    parts = [df.select("query_id", "memory_id", F.lit(name).alias("channel"), "rank", reciprocal_rank(F.col("rank"), k, w).alias("part")) for name, (df, k, w) in channels.items()]
    ranks = [F.max(F.when(F.col("channel") == name, F.col("rank"))).alias(f"{name}_rank") for name in channels]
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", "memory_id").agg(F.sum("part").alias("score"), *ranks)


def with_exploration(fused: DataFrame, summary: DataFrame, prior: DataFrame, params: Scoring = SCORING) -> DataFrame:
    """Scores times the exploration factor of the memories' feedback; ``prior`` is one row."""
    joined = fused.join(summary.select("memory_id", "fb_ewma", "fb_count"), "memory_id", "left").crossJoin(F.broadcast(prior))
    factor = exploration(F.col("fb_ewma"), F.col("fb_count"), F.col("prior_mean"), F.col("prior_strength"), params)
    return joined.withColumn("score", F.col("score") * factor).drop("fb_ewma", "fb_count", "prior_mean", "prior_strength")


def co_retrieval(retrieved: DataFrame) -> DataFrame:
    """(memory_id, query): distinct queries that returned a memory."""
    return retrieved.where("query is not null and memory_id is not null").select("memory_id", "query").distinct()


def with_hebbian(scored: DataFrame, seen: DataFrame, params: Scoring = SCORING) -> DataFrame:
    """Scores plus a share of the pointwise mutual information of candidates with the query's first five, by past queries.

    ``seen`` is (memory_id, query). Only pairs retrieved together at least twice count, and the sum is capped. Pairs are
    formed of a query's five seeds with its own candidates, never of all memories that a past query returned. Pasts of fewer than five queries say nothing.
    """
    total = seen.agg(F.count_distinct("query").alias("total"))
    counts = seen.groupBy("memory_id").agg(F.count(F.lit(1)).alias("n"))
    seeds = top_k(scored, "query_id", [F.desc("score"), F.col("memory_id")], params.hebbian_seeds, "at").select("query_id", F.col("memory_id").alias("seed"))
    others = scored.select("query_id", "memory_id").join(seeds.select("query_id", F.col("seed").alias("memory_id")), ["query_id", "memory_id"], "left_anti")
    pairs = others.join(seeds, "query_id").select("seed", "memory_id").distinct()
    joint = (
        pairs.join(seen, "memory_id")
        .join(seen.select(F.col("memory_id").alias("seed"), F.col("query")), ["seed", "query"])
        .groupBy("seed", "memory_id")
        .agg(F.count(F.lit(1)).alias("joint"))
        .where(F.col("joint") >= params.hebbian_joint)
    )
    known = joint.join(counts, "memory_id").join(counts.select(F.col("memory_id").alias("seed"), F.col("n").alias("n_seed")), "seed").crossJoin(F.broadcast(total))
    pmi = F.log2(F.col("joint") * F.col("total") / (F.col("n").cast("double") * F.col("n_seed")))
    worth = known.where(F.col("total") >= params.hebbian_queries).select("seed", "memory_id", F.least(F.greatest(F.lit(0.0), params.hebbian * pmi), F.lit(params.hebbian_cap)).alias("boost"))
    boosts = others.join(seeds, "query_id").join(worth, ["seed", "memory_id"]).groupBy("query_id", "memory_id").agg(F.least(F.sum("boost"), F.lit(params.hebbian_cap)).alias("boost"))
    return scored.join(boosts, ["query_id", "memory_id"], "left").withColumn("score", F.col("score") + F.coalesce("boost", F.lit(0.0))).drop("boost")


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, neighbour, weight) in both directions, without links that mark contradictions.

    A missing weight is 1. Links with a missing end are dropped, repeated rows of one id count once; parallel links each carry their own weight.
    """
    one = edges.where("id is not null and source_id is not null and target_id is not null").dropDuplicates(["id"])
    clean = one.where(~F.coalesce(F.array_contains("flags", "contradiction"), F.lit(False))).select("source_id", "target_id", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    return clean.select(F.col("source_id").alias("node"), F.col("target_id").alias("neighbour"), "weight").unionByName(clean.select(F.col("target_id").alias("node"), F.col("source_id").alias("neighbour"), "weight"))


def spread_activation(seeds: DataFrame, adj: DataFrame, params: Scoring = SCORING) -> DataFrame:
    """(query_id, node, ppr): personalised PageRank from each query's seeds (query_id, memory_id, score) over two hops.

    Each query walks its own subgraph: links that touch a seed or a neighbour of a seed. A fixed number of steps is
    taken; with this damping, twelve leave less than 1e-7. Mass at nodes without links is dropped. Each step is a join
    by (query, node) and a sum with partial aggregates; lineage is cut every four steps.
    """
    total = seeds.groupBy("query_id").agg(F.sum("score").alias("total")).where("total > 0")
    start = seeds.join(total, "query_id").select("query_id", F.col("memory_id").alias("node"), (F.col("score") / F.col("total")).alias("seed"))
    near = start.select("query_id", "node").unionByName(start.join(adj, "node").select("query_id", F.col("neighbour").alias("node"))).distinct()
    # Every link that touches one of these, in both directions.
    out = near.join(adj, "node").select("query_id", "node", "neighbour", "weight")
    back = out.select("query_id", F.col("neighbour").alias("node"), F.col("node").alias("neighbour"), "weight")
    links = out.unionByName(back.join(near, ["query_id", "node"], "left_anti"))
    degree = links.groupBy("query_id", "node").agg(F.sum("weight").alias("degree")).where("degree > 0")
    links = checkpoint(links.join(degree, ["query_id", "node"]).select("query_id", "node", "neighbour", (F.col("weight") / F.col("degree")).alias("share")))
    rest = start.select("query_id", "node", (F.lit(1 - params.ppr_damping) * F.col("seed")).alias("ppr"))
    state = start.select("query_id", "node", F.col("seed").alias("ppr"))
    for step in range(params.ppr_steps):
        flow = state.join(links, ["query_id", "node"]).select("query_id", F.col("neighbour").alias("node"), (F.lit(params.ppr_damping) * F.col("ppr") * F.col("share")).alias("ppr"))
        state = flow.unionByName(rest).groupBy("query_id", "node").agg(F.sum("ppr").alias("ppr"))
        if step % 4 == 3:
            state = checkpoint(state)
    return state.where("ppr > 0")


def with_expansion(scored: DataFrame, adj: DataFrame, active: DataFrame, params: Scoring = SCORING) -> DataFrame:
    """Scores plus activation spread from each query's first five; at most twenty new memories join, active ones only.

    New ones are the most activated, ties by id. ``active`` is (memory_id). Seeds get nothing.
    """
    seeds = checkpoint(top_k(scored, "query_id", [F.desc("score"), F.col("memory_id")], params.ppr_seeds, "at").select("query_id", "memory_id", "score"))
    ppr = spread_activation(seeds, adj, params).withColumnRenamed("node", "memory_id").join(seeds.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_anti")
    boosted = scored.join(ppr, ["query_id", "memory_id"], "left").withColumn("score", F.col("score") + F.coalesce(params.ppr_boost * F.col("ppr"), F.lit(0.0))).drop("ppr")
    new = top_k(ppr.join(scored.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_anti"), "query_id", [F.desc(F.round("ppr", 12)), F.col("memory_id")], params.ppr_new, "at").drop("at")
    added = new.join(active, "memory_id", "left_semi").select("query_id", "memory_id", (params.ppr_boost * F.col("ppr")).alias("score"))
    return boosted.unionByName(added, allowMissingColumns=True)


def within_budget(ranked: DataFrame, budget: int) -> DataFrame:
    """The ranked prefix (query_id, rank, tokens) of each query whose running token count stays within the budget."""
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum("tokens").over(order)).where(F.col("used") <= budget)


def contradictions(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, memory_a, memory_b): pairs of a query's results between which a link marks a contradiction."""
    marked = edges.where(F.array_contains("flags", "contradiction") & (F.col("source_id") != F.col("target_id")))
    pairs = marked.select(F.least("source_id", "target_id").alias("memory_a"), F.greatest("source_id", "target_id").alias("memory_b")).where("memory_a is not null and memory_b is not null").distinct()
    hits = ranked.select("query_id", "memory_id").distinct()
    return pairs.join(hits.withColumnRenamed("memory_id", "memory_a"), "memory_a").join(hits.withColumnRenamed("memory_id", "memory_b"), ["query_id", "memory_b"]).select("query_id", "memory_a", "memory_b")
