"""The link graph: degrees, neighbourhoods, new links without repeats, diversity and shadows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.functions.vectors import cosine
from mnemospark.operators.nearest import nearest_before
from mnemospark.runtime import checkpoint


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One row per link id; repeated rows are copies."""
    return edges.where("id is not null").dropDuplicates(["id"])


def pairs_of(edges: DataFrame) -> DataFrame:
    """(low, high): linked pairs in either direction, each once; null ends and self-links are left out."""
    both = edges.where("source_id is not null and target_id is not null and source_id <> target_id")
    return both.select(F.least("source_id", "target_id").alias("low"), F.greatest("source_id", "target_id").alias("high")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(memory_id, links, neighbours): links of a memory at either end, and how many others they lead to."""
    ends = distinct_edges(edges).where("source_id is not null and target_id is not null")
    both = ends.select(F.col("source_id").alias("memory_id"), F.col("target_id").alias("other")).unionByName(ends.select(F.col("target_id").alias("memory_id"), F.col("source_id").alias("other")))
    return both.groupBy("memory_id", "other").agg(F.count(F.lit(1)).alias("n")).groupBy("memory_id").agg(F.sum("n").alias("links"), F.count(F.when(F.col("other") != F.col("memory_id"), 1)).alias("neighbours"))


def two_hops(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, node, hops): what each seed (memory_id) reaches over one or two links, by the shorter way."""
    low = pairs_of(edges)
    adj = low.select(F.col("low").alias("node"), F.col("high").alias("next")).unionByName(low.select(F.col("high").alias("node"), F.col("low").alias("next")))
    one = seeds.select(F.col("memory_id").alias("seed"), F.col("memory_id").alias("node")).distinct().join(adj, "node").select("seed", F.col("next").alias("node"))
    two = one.join(adj, "node").select("seed", F.col("next").alias("node")).where("seed <> node")
    reached = one.withColumn("hops", F.lit(1)).unionByName(two.withColumn("hops", F.lit(2)))
    return reached.groupBy("seed", "node").agg(F.min("hops").alias("hops"))


def new_links(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) that no link joins in either direction yet, each once."""
    wanted = candidates.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct()
    return wanted.join(pairs_of(edges), ["low", "high"], "left_anti").select(F.col("low").alias("a"), F.col("high").alias("b"))


def dangling(edges: DataFrame, memories: DataFrame) -> DataFrame:
    """(id, missing): links of which an end is null (null_end) or names no memory (source, target, both)."""
    known = memories.where("id is not null").select(F.col("id").alias("k")).distinct()
    e = distinct_edges(edges).select("id", "source_id", "target_id")
    s = e.join(known.select(F.col("k").alias("source_id"), F.lit(True).alias("s")), "source_id", "left")
    both = s.join(known.select(F.col("k").alias("target_id"), F.lit(True).alias("t")), "target_id", "left")
    missing = F.when(F.col("source_id").isNull() | F.col("target_id").isNull(), "null_end").when(F.col("s").isNull() & F.col("t").isNull(), "both").when(F.col("s").isNull(), "source").when(F.col("t").isNull(), "target")
    return both.select("id", missing.alias("missing")).where("missing is not null")


def first_vectors(vectors: DataFrame, dim: int = 384) -> DataFrame:
    """(memory_id, embedding) of usable vectors, one per memory: length ``dim`` and not all zero."""
    usable = vectors.where((F.size("embedding") == dim) & F.exists("embedding", lambda x: x != 0) & F.col("memory_id").isNotNull())
    return usable.dropDuplicates(["memory_id"]).select("memory_id", "embedding")


def linked_cosines(edges: DataFrame, vectors: DataFrame, dim: int = 384) -> DataFrame:
    """(low, high, cosine) of linked pairs of which both have a usable vector."""
    v = first_vectors(vectors, dim)
    pairs = pairs_of(edges)
    a = pairs.join(v.select(F.col("memory_id").alias("low"), F.col("embedding").alias("x")), "low")
    both = a.join(v.select(F.col("memory_id").alias("high"), F.col("embedding").alias("y")), "high")
    return both.select("low", "high", cosine(F.col("x"), F.col("y")).alias("cosine"))


def diversity(cosines: DataFrame) -> DataFrame:
    """(memory_id, diversity): 1 less the mean similarity to its linked neighbours."""
    both = cosines.select(F.col("low").alias("memory_id"), "cosine").unionByName(cosines.select(F.col("high").alias("memory_id"), "cosine"))
    return both.groupBy("memory_id").agg((1 - F.avg("cosine")).alias("diversity"))


def shadow_load(memories: DataFrame, vectors: DataFrame, dim: int = 384) -> DataFrame:
    """(memory_id, shadow): how much the most similar newer memory, linked or not, covers each that has a usable vector, 0 at similarity 0.7 to 1 at 0.95."""
    held = memories.select("id", "created_at").join(first_vectors(vectors, dim).select(F.col("memory_id").alias("id"), F.col("embedding").alias("vector")), "id")
    newer = nearest_before(held.select("id", F.lit("").alias("kind"), (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("place"), "vector"), dim=dim)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("cosine") - 0.7) / 0.25))
    return held.select(F.col("id").alias("memory_id")).join(newer.select(F.col("id").alias("memory_id"), share.alias("shadow")), "memory_id", "left").fillna(0.0, ["shadow"])


class _Graph:
    """A graph in memory: pairs of numbers, sorted by node, and the sums that run over its links."""

    def __init__(self, low: np.ndarray, high: np.ndarray) -> None:
        self.ids, at = np.unique(np.concatenate([low, high]), return_inverse=True)
        a, b = at[: len(low)], at[len(low) :]
        node, other = np.concatenate([a, b]), np.concatenate([b, a])
        self.other = other[np.argsort(node, kind="stable")].astype(np.int32)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(node, minlength=len(self.ids)))])

    def links(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each row's links begin among those of all rows, and where they lead. Every node has links."""
        n = self.start[rows + 1] - self.start[rows]
        begin = np.cumsum(n) - n
        return begin, self.other[np.repeat(self.start[rows] - begin, n) + np.arange(n.sum())]

    def spread(self, rows: np.ndarray, x: np.ndarray, most: int = 6_000_000) -> np.ndarray:
        """Sums of ``x`` over the neighbours of each row."""
        out = np.empty((len(rows), x.shape[1]))
        ends = np.cumsum(self.start[rows + 1] - self.start[rows])
        s = 0
        while s < len(rows):
            e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + most // x.shape[1], side="right")))
            begin, other = self.links(rows[s:e])
            out[s:e] = np.add.reduceat(x[other], begin, axis=0)
            s = e
        return out

    def dependencies(self, sources: np.ndarray) -> np.ndarray:
        """Brandes' sums of each node over the sources, all of these at once; a level costs what its nodes' links are."""
        n, b = len(self.ids), len(sources)
        level, paths, here = np.full((n, b), -1, dtype=np.int32), np.zeros((n, b)), np.zeros((n, b))
        level[sources, np.arange(b)] = 0
        paths[sources, np.arange(b)] = here[sources, np.arange(b)] = 1.0
        levels = [np.unique(sources)]
        while len(levels[-1]):
            met = np.zeros(n, dtype=bool)
            met[self.links(levels[-1])[1]] = True
            rows = np.flatnonzero(met)
            reached = self.spread(rows, here)
            reached[level[rows] >= 0] = 0.0
            new = reached > 0
            some = new.any(axis=1)
            here[levels[-1]] = 0.0
            rows, reached, new = rows[some], reached[some], new[some]
            paths[rows] += reached
            level[rows] = np.where(new, len(levels), level[rows])
            here[rows] = reached
            levels.append(rows)
        depends = np.zeros((n, b))
        for d in range(len(levels) - 2, 1, -1):
            rows, before = levels[d], levels[d - 1]
            here[rows] = np.divide(1 + depends[rows], paths[rows], out=np.zeros((len(rows), b)), where=level[rows] == d)
            depends[before] += np.where(level[before] == d - 1, paths[before] * self.spread(before, here), 0.0)
            here[rows] = 0.0
        return depends.sum(axis=1)


def _in_bytes(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                data = np.stack([np.asarray(batch.column(c), dtype=np.int64) for c in columns])
                yield pa.RecordBatch.from_arrays([pa.array([data.tobytes()], pa.binary())], ["data"])

    return run


def _shares_of(at_once: int):
    """Of a share: the graph, then its sources; gives the sums of all nodes that have one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, sources = [], []
        for batch in batches:
            for part, data, number in zip(*(batch.column(c).to_pylist() for c in ("part", "data", "number"))):
                if part:
                    sources.append(number)
                else:
                    pairs.append(np.frombuffer(data, dtype=np.int64).reshape(2, -1))
        if not pairs or not sources:
            return
        graph = _Graph(*np.concatenate(pairs, axis=1))
        pairs.clear()
        at, total = np.searchsorted(graph.ids, np.array(sources)), np.zeros(len(graph.ids))
        size = max(1, min(64, at_once // len(graph.ids)))
        for s in range(0, len(at), size):
            total += graph.dependencies(at[s : s + size])
        some = np.flatnonzero(total)
        for s in range(0, len(some), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(graph.ids[some[s : s + 50_000]]), pa.array(total[some[s : s + 50_000]])], ["number", "dependency"])

    return run


def betweenness(edges: DataFrame, sources: DataFrame, active: DataFrame | None = None, shares: int = 24, at_once: int = 8_000_000) -> DataFrame:
    """(memory_id, betweenness): shortest paths from the stated sources that run through a memory, whatever their length.

    Brandes' sums over levels: forward, path counts level by level until nothing new is reached; backward, dependencies from
    the farthest level in. Both directions of a pair count. With ``active`` memories (memory_id) paths run through these only, and sums are
    divided by (n - 1)(n - 2) / 2 for their number n. Sources are dealt to ``shares``, each of which gets the whole graph as pairs of numbers (16 bytes a
    pair) and gives one sum a node, so that no state by (source, node) is ever written; ``at_once`` such states are held in a task. A graph has to fit a task's memory, by about 60 bytes a link.
    """
    low = pairs_of(edges)
    if active is not None:
        known = active.select("memory_id").distinct()
        low = low.join(known.withColumnRenamed("memory_id", "low"), "low", "left_semi").join(known.withColumnRenamed("memory_id", "high"), "high", "left_semi")
    low = checkpoint(low)
    nodes = checkpoint(low.select(F.col("low").alias("memory_id")).unionByName(low.select(F.col("high").alias("memory_id"))).distinct().withColumn("number", F.monotonically_increasing_id()))
    numbered = low.join(nodes.select(F.col("memory_id").alias("low"), F.col("number").alias("a")), "low").join(nodes.select(F.col("memory_id").alias("high"), F.col("number").alias("b")), "high")
    graph = numbered.select("a", "b").mapInArrow(_in_bytes(["a", "b"]), "data binary").select(F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("part"), "data", F.lit(None).cast("long").alias("number"))
    asked = sources.select("memory_id").distinct().join(nodes, "memory_id").select(F.pmod(F.xxhash64("number"), F.lit(shares)).cast("int").alias("share"), F.lit(1).alias("part"), F.lit(None).cast("binary").alias("data"), "number")
    found = graph.unionByName(asked).repartitionById(shares, F.col("share")).mapInArrow(_shares_of(at_once), "number long, dependency double")
    total = found.groupBy("number").agg(F.sum("dependency").alias("betweenness")).where("betweenness > 0").join(nodes, "number").select("memory_id", "betweenness")
    n = known.count() if active is not None else 0
    return total.withColumn("betweenness", F.col("betweenness") / ((n - 1) * (n - 2) / 2)) if n > 2 else total
