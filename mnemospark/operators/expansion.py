"""Second looks: candidates added to a query's first results by what those have in common."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.text import normal_themes, words
from mnemospark.operators.retrieval import TERM_CELLS, keyword_channel, top_k
from mnemospark.operators.search import best_in_cells, by_terms, each_query, marked, unpacked, with_vectors
from mnemospark.runtime import checkpoint


def feedback_terms(seeds: DataFrame, queries: DataFrame, memories: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, term, weight, rank): the k words that set the seeds (query_id, memory_id) apart, the query's own left out.

    A word weighs its count in the seeds' summaries times its rarity among all of them; words of fewer than three letters are left out.
    """
    text = memories.select(F.col("id").alias("memory_id"), words(F.col("summary")).alias("w"))
    n = memories.agg(F.count(F.lit(1)).alias("n"))
    df = text.select("memory_id", F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    tf = seeds.select("query_id", "memory_id").join(text, "memory_id").select("query_id", F.explode("w").alias("term")).where(F.length("term") >= 3).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    own = queries.select("query_id", F.explode(F.array_distinct(words(F.col("query")))).alias("term"))
    weighed = tf.join(own, ["query_id", "term"], "left_anti").join(df, "term").crossJoin(F.broadcast(n))  # one row
    scored = weighed.select("query_id", "term", F.round(F.col("tf") * F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1), 9).alias("weight"))
    return top_k(scored, "query_id", [F.desc("weight"), F.col("term")], k)


def by_feedback_terms(seeds: DataFrame, queries: DataFrame, memories: DataFrame, pool: DataFrame, k: int = 30) -> DataFrame:
    """(query_id, memory_id, bm25, rank): what a search for those words finds beyond the ``pool``."""
    terms = feedback_terms(seeds, queries, memories)
    again = terms.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_list("term")), " ").alias("query"))  # ten words a query
    return keyword_channel(again, memories, k=k, without=pool)


def by_session(seeds: DataFrame, memories: DataFrame, pool: DataFrame, per_seed: int = 5) -> DataFrame:
    """(query_id, memory_id): up to five newest memories of each seed's session that aren't in the pool.

    Of a session no more can be needed than the largest pool holds, one seed and ``per_seed`` others; so many of its
    newest are looked at, however long the session is.
    """
    largest = pool.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first().n
    timed = memories.where("session_id is not null").select(F.col("id").alias("memory_id"), "session_id", "created_at")
    newest = top_k(timed, "session_id", [F.desc("created_at"), F.col("memory_id")], largest + per_seed + 1, "at").select("session_id", F.col("memory_id").alias("other"), "at")
    hits = seeds.select("query_id", "memory_id").join(timed.select("memory_id", "session_id"), "memory_id").join(newest, "session_id").where("other <> memory_id")
    new = hits.select("query_id", "memory_id", "other", "at").join(pool.select("query_id", F.col("memory_id").alias("other")), ["query_id", "other"], "left_anti")
    keyed = new.withColumn("seed", F.struct("query_id", "memory_id"))
    return top_k(keyed, "seed", [F.col("at"), F.col("other")], per_seed, "n").select("query_id", F.col("other").alias("memory_id")).distinct()


def by_theme_bridge(seeds: DataFrame, queries: DataFrame, memories: DataFrame, pool: DataFrame, k: int = 30) -> DataFrame:
    """(query_id, memory_id, shared, rank): memories beyond the pool by themes that the seeds have and the query doesn't name."""
    themed = memories.select(F.col("id").alias("memory_id"), F.explode(normal_themes(F.col("themes"))).alias("theme"))
    named = queries.select("query_id", F.explode(words(F.col("query"))).alias("theme"))
    bridges = seeds.select("query_id", "memory_id").join(themed, "memory_id").select("query_id", "theme").distinct().join(named, ["query_id", "theme"], "left_anti")
    text = memories.select("id", F.concat_ws(" ", normal_themes(F.col("themes"))).alias("first"), F.lit("").alias("second"))
    asked = bridges.groupBy("query_id").agg(F.sort_array(F.collect_list("theme")).alias("t"))  # themes of five seeds, which have no spaces
    asked = asked.select("query_id", F.array_join("t", " ").alias("terms"), F.transform("t", lambda _: F.lit(1.0)).alias("weights"), F.size("t").alias("n_terms"), F.lit(1.0).alias("mean"), F.lit(0).alias("all_terms"))
    found = best_in_cells(asked, text, by_terms(1.0, 1.0), k, *TERM_CELLS, without=pool.select("query_id", F.col("memory_id").alias("id")))
    return top_k(found.select("query_id", F.col("id").alias("memory_id"), F.col("score").cast("long").alias("shared")), "query_id", [F.desc("shared"), F.col("memory_id")], k)


def by_centroid(seeds: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, vector): the mean of the seeds' vectors (memory_id, embedding), number by number, for a search of its own."""
    each = seeds.select("query_id", "memory_id").join(vectors, "memory_id").select("query_id", F.posexplode("embedding").alias("i", "x"))
    means = each.groupBy("query_id", "i").agg(F.avg("x").alias("x"))
    return means.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vector"))  # one number a dimension


def toward_centroid(asked: DataFrame, seeds: DataFrame, vectors: DataFrame, own: float = 0.7) -> DataFrame:
    """(query_id, vector): each query's vector moved toward the mean of its seeds', of length 1; the query's own share is ``own``.

    ``asked`` is (query_id, vector). A query without seeds that have a vector keeps its own.
    """
    mean = by_centroid(seeds, vectors).withColumnRenamed("vector", "mean")
    mixed = F.when(F.col("mean").isNull(), F.col("vector")).otherwise(F.zip_with("vector", "mean", lambda q, m: own * q + (1 - own) * m))
    rows = asked.join(mean, "query_id", "left").select("query_id", mixed.alias("vector"))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    return rows.select("query_id", F.transform("vector", lambda x: x / length).alias("vector"))


# Words that say nothing about what a question asks for.
STOPWORDS = "the and for with from that this what when where which who why how did does are was were our you your has have had not can could should would will about into over".split()


def word_pairs(queries: DataFrame, most: int = 8) -> DataFrame:
    """(query_id, place, query): sub-queries of two words each, in order, of the first five words that say something."""
    said = F.slice(F.filter(F.array_distinct(words(F.col("query"))), lambda w: (F.length(w) >= 3) & ~w.isin(STOPWORDS)), 1, 5)
    listed = queries.select("query_id", F.posexplode(said).alias("i", "a"), said.alias("said"))
    pairs = listed.where("i < 4").select("query_id", "i", "a", F.posexplode(F.slice("said", F.col("i") + 2, F.size("said"))).alias("j", "b"))
    return top_k(pairs, "query_id", [F.col("i"), F.col("j")], most, "place").select("query_id", "place", F.concat_ws(" ", "a", "b").alias("query"))


def by_word_pairs(queries: DataFrame, memories: DataFrame, pool: DataFrame, k: int = 30, each: int = 20) -> DataFrame:
    """(query_id, memory_id, score, rank): beyond the pool, what the sub-queries find, both words being there, by summed reciprocal ranks."""
    pairs = word_pairs(queries)
    asked = pairs.select(F.concat_ws("|", "query_id", "place").alias("query_id"), "query", F.col("query_id").alias("of"))
    found = keyword_channel(asked.select("query_id", "query"), memories, k=each).join(asked.select("query_id", "of"), "query_id")
    new = found.select(F.col("of").alias("query_id"), "memory_id", "rank").join(pool.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_anti")
    scored = new.groupBy("query_id", "memory_id").agg(F.round(F.sum(1 / (60.0 + F.col("rank"))), 9).alias("score"))
    return top_k(scored, "query_id", [F.desc("score"), F.col("memory_id")], k)


def by_links(hits: DataFrame, seeds: DataFrame, adj: DataFrame, vectors: DataFrame, pool: DataFrame, among: DataFrame) -> DataFrame:
    """(query_id, memory_id, novelty): memories linked to a seed and beyond the pool, by what they add to the seed for the query.

    A query's vector is the mean of those of its ``hits`` (query_id, memory_id). ``adj`` is (node, neighbour, weight), ``vectors`` (memory_id, embedding) unchecked,
    ``among`` (memory_id) what may be added. Of several seeds the one beside which a memory is most novel counts. A memory, seed or query without a vector
    gives none. Vectors are shuffled once for all three; a query's few hits and seeds are held, its links pass by.
    """
    ends = seeds.select("query_id", F.col("memory_id").alias("node")).join(adj.select("node", "neighbour"), "node").where("node <> neighbour").distinct()
    new = ends.join(pool.select("query_id", F.col("memory_id").alias("neighbour")), ["query_id", "neighbour"], "left_anti").join(among.select(F.col("memory_id").alias("neighbour")), "neighbour", "left_semi")
    part = lambda df, n, node: df.select("query_id", "memory_id", F.lit(n).alias("part"), node.alias("node"))
    wanted = reduce(DataFrame.unionByName, [part(hits, 0, F.lit(None).cast("string")), part(seeds, 1, F.lit(None).cast("string")), part(new.withColumnRenamed("neighbour", "memory_id"), 2, F.col("node"))])

    def work(query: object, parts: list[list[tuple[str, np.ndarray]]], rest: pa.RecordBatch | None) -> list[pa.Array] | None:
        if rest is None or not parts[0] or not parts[1]:
            return None
        held = {m: v.astype(np.float64) for m, v in parts[1]}
        q = np.mean([v.astype(np.float64) for _, v in parts[0]], axis=0)
        length, found = np.sqrt(q @ q), []
        for memory, node, x in zip(*(rest.column(c).to_pylist() for c in ("memory_id", "node", "packed"))):
            if node not in held:
                continue
            s, n = held[node], unpacked(x).astype(np.float64)
            own = n - (n @ s) / (s @ s) * s
            size = np.sqrt(own @ own)
            found.append((memory, 0.0 if size < 1e-8 else 1.0 if length == 0 else min(1.0, max(0.0, float(q @ own / (length * size))))))
        return [pa.array([query] * len(found), rest.schema.field("query_id").type), pa.array([m for m, _ in found], pa.string()), pa.array([v for _, v in found], pa.float64())]

    scored = each_query(with_vectors(wanted, vectors), work, f"query_id {dict(seeds.dtypes)['query_id']}, memory_id string, novelty double")
    return scored.groupBy("query_id", "memory_id").agg(F.max("novelty").alias("novelty"))


def moved_vectors(hits: DataFrame, seeds: DataFrame, vectors: DataFrame, own: float = 0.7) -> DataFrame:
    """(query_id, vector): the mean vector of each query's ``hits`` moved toward that of its seeds, both (query_id, memory_id); as ``toward_centroid``, with only the vectors of these shuffled.

    ``vectors`` is (memory_id, embedding), unchecked. Queries without a hit that has a vector give none.
    """
    part = lambda df, n: df.select("query_id", "memory_id", F.lit(n).alias("part"))
    kind = dict(hits.dtypes)["query_id"]

    def work(query: object, parts: list[list[tuple[str, np.ndarray]]], rest: pa.RecordBatch | None) -> list[pa.Array] | None:
        if not parts[0]:
            return None
        q, m = (np.mean([v.astype(np.float64) for _, v in p], axis=0) if p else None for p in parts)
        x = q if m is None else own * q + (1 - own) * m
        length = np.sqrt(x @ x)
        return [pa.array([query]), pa.array([x / length if length else x], pa.list_(pa.float64()))]

    wanted = checkpoint(part(hits, 0).unionByName(part(seeds, 1)))  # a few rows a query
    return each_query(with_vectors(wanted, vectors, marks=marked(wanted)), work, f"query_id {kind}, vector array<double>")


def together(found: dict[str, DataFrame]) -> DataFrame:
    """(query_id, memory_id, methods): what several expansions found, with the names of those that did, in alphabetical order."""
    parts = [df.select("query_id", "memory_id", F.lit(name).alias("method")) for name, df in found.items()]
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("query_id", "memory_id").agg(F.array_join(F.array_sort(F.collect_set("method")), "+").alias("methods"))
