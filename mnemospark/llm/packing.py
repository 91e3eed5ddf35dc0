"""Documents packed into containers of fixed capacity by optimal length buckets.

A dynamic programme over the global histogram of lengths chooses the bucket boundaries that minimise padding, the
room between an item and its bucket's boundary. Then token-budget batches form: first within the bucket of an item,
as many as the budget allows, and what is left of the budget is filled from the largest smaller bucket that still fits, since
batches of one bucket alone leave up to half a container empty where items are longer than half of it. Both steps
see counts only: at most one per length up to the capacity, and one per bucket. A plan says how many containers have which mix of
buckets; each document finds its container from its rank within its bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.runtime import checkpoint

#: Buckets per capacity, and items that one task ranks within a bucket.
BUCKETS, RANKED = 96, 1_000_000


def _layer(best: np.ndarray, lengths: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One bucket more: for each last length the least padded size and the length after which the last bucket starts.

    The best start never moves back as the last length grows (the cost is Monge), so the starts of the middle lengths bound
    those of the rest: all lengths of one level of the halving are worked out together, a level in linear time.
    """
    m = len(lengths)
    value, choice = best.copy(), np.zeros(m, dtype=np.int64)
    first, last, low, high = np.array([1]), np.array([m - 1]), np.array([0]), np.array([m - 2])
    while len(first):
        mid = (first + last) // 2
        top = np.minimum(high, mid - 1)
        n = top - low + 1
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])
        j = np.arange(n.sum()) - np.repeat(begin, n) + np.repeat(low, n)
        cost = best[j] + np.repeat(lengths[mid], n) * (np.repeat(upto[mid + 1], n) - upto[j + 1])
        least = np.minimum.reduceat(cost, begin)
        at = np.minimum.reduceat(np.where(cost == np.repeat(least, n), j, m), begin)
        value[mid], choice[mid] = least, at
        first, last, low, high = (np.concatenate(x) for x in ((first, mid + 1), (mid - 1, last), (low, at), (at, high)))
        keep = first <= last
        first, last, low, high = first[keep], last[keep], low[keep], high[keep]
    return value, choice


def bucket_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Upper boundaries that minimise the sum of (boundary - length) over all items, by dynamic programming.

    ``lengths`` are distinct and ascending; each may be a boundary.
    """
    lengths, m = np.asarray(lengths, dtype=float), len(lengths)
    k = min(buckets, m)
    upto = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    best = lengths * upto[1:]  # padded size of the first i + 1 lengths in one bucket
    choices = []
    for _ in range(1, k):
        value, choice = _layer(best, lengths, upto)
        # Fewer buckets are as good where another one saves nothing.
        choice[value >= best] = -1
        best = np.minimum(value, best)
        choices.append(choice)
    # Walk back through the choices.
    at, found = m - 1, [m - 1]
    for choice in reversed(choices):
        if choice[at] >= 0 and at > 0:
            at = int(choice[at])
            found.append(at)
    return lengths[np.array(sorted(set(found)))].astype(np.int64)


def fill_plan(boundaries: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(items per bucket, number of such containers): batches by token budget, longest bucket first."""
    left, plan = counts.astype(np.int64).copy(), []
    while left.any():
        mix, room = np.zeros(len(boundaries), dtype=np.int64), capacity
        for i in range(len(boundaries) - 1, -1, -1):
            if left[i] and boundaries[i] <= room:
                mix[i] = min(left[i], room // boundaries[i])
                room -= mix[i] * boundaries[i]
        used = mix > 0
        times = int((left[used] // mix[used]).min())
        left -= mix * times
        plan.append((mix, times))
    return plan


def _assigner(plans: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, buckets, ranks = batch.column("profile").to_pylist(), np.asarray(batch.column("bucket")), np.asarray(batch.column("rank"))
            out = np.empty(len(ranks), dtype=np.int64)
            for name in set(names):
                rows = np.flatnonzero(np.array([n == name for n in names]))
                key, per, base, width = plans[name]  # sorted by bucket and first rank
                at = np.searchsorted(key, buckets[rows] * width + ranks[rows], "right") - 1
                out[rows] = base[at] + (buckets[rows] * width + ranks[rows] - key[at]) // per[at]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("profile", "doc_id", "piece", "tokens")], pa.array(out)], ["profile", "doc_id", "piece", "tokens", "container"])

    return run


def pack(sizes: DataFrame, profiles: list[tuple[str, int]]) -> DataFrame:
    """(profile, doc_id, piece, tokens, container) for ``sizes`` (doc_id, tokens) and each (profile, capacity).

    An item larger than the capacity is split: pieces 0, 1, .. fill a container each, and the rest is packed as an item. Others
    have piece 0. Items without tokens (null, empty texts) take no room: container null. Repeated ids are items in their own
    right only if given twice; ties in length are broken by the id. Containers are numbered from 0 for each profile.
    """
    sizes = checkpoint(sizes.select("doc_id", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")))
    spark = sizes.sparkSession
    limits = F.broadcast(spark.createDataFrame(profiles, "profile string, capacity int"))  # the driver's own short list
    every = sizes.crossJoin(limits).where("tokens > 0")
    full = F.floor(F.col("tokens") / F.col("capacity"))
    rest = every.withColumn("piece", F.when(F.col("tokens") % F.col("capacity") == 0, full - 1).otherwise(full)).withColumn("tokens", F.col("tokens") - F.col("piece") * F.col("capacity"))
    histogram = rest.groupBy("profile", "tokens").agg(F.count(F.lit(1)).alias("n")).toPandas()  # one row per length up to the capacity
    bounds: dict[str, np.ndarray] = {}
    for name, _ in profiles:
        own = histogram[histogram.profile == name].sort_values("tokens")
        bounds[name] = bucket_boundaries(own.tokens.to_numpy(), own.n.to_numpy()) if len(own) else np.array([1])
    most = int(histogram.groupby("profile").n.sum().max()) if len(histogram) else 0
    parts_each = max(64, -(-most // RANKED))
    edges = spark.createDataFrame([(n, [int(x) for x in b]) for n, b in bounds.items()], "profile string, bounds array<long>")
    bucket = F.expr("size(filter(bounds, x -> x < tokens))")
    placed = (
        rest.join(F.broadcast(edges), "profile")
        .withColumn("bucket", bucket.cast("long"))
        .withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts_each)))
        .select("profile", "doc_id", "piece", "tokens", "bucket", "part")
    )
    placed = checkpoint(placed.withColumn("within", F.row_number().over(Window.partitionBy("profile", "bucket", "part").orderBy("doc_id", "piece")) - 1))
    parts = placed.groupBy("profile", "bucket", "part").agg(F.count(F.lit(1)).alias("n"))  # one row for at most RANKED items
    before = parts.withColumn("before", F.sum("n").over(Window.partitionBy("profile", "bucket").orderBy("part")) - F.col("n"))
    counted = before.groupBy("profile", "bucket").agg(F.sum("n").alias("n")).toPandas()
    pieces = every.withColumn("piece", F.when(F.col("tokens") % F.col("capacity") == 0, full - 1).otherwise(full)).where("piece > 0")

    plans, containers = {}, {}
    for name, capacity in profiles:
        own = counted[counted.profile == name]
        n = np.zeros(len(bounds[name]), dtype=np.int64)
        n[own.bucket.to_numpy(dtype=np.int64)] = own.n.to_numpy()
        width, rows, used, base = int(n.max(initial=0)) + 1, [], np.zeros(len(n), dtype=np.int64), 0
        for mix, times in fill_plan(bounds[name], n, capacity):
            for b in np.flatnonzero(mix):
                rows.append((b * width + used[b], mix[b], base))
                used[b] += mix[b] * times
            base += times
        rows.sort()
        plans[name] = (*(np.array([r[i] for r in rows], dtype=np.int64) for i in range(3)), width)
        containers[name] = base
    ranked = placed.join(before.drop("n"), ["profile", "bucket", "part"]).select("profile", "doc_id", "piece", "tokens", "bucket", (F.col("before") + F.col("within")).alias("rank"))
    kind = dict(sizes.dtypes)["doc_id"]
    packed = ranked.mapInArrow(_assigner(plans), f"profile string, doc_id {kind}, piece long, tokens long, container long")
    # Full pieces of oversized items get containers of their own, numbered after the others by running totals.
    first = spark.createDataFrame(list(containers.items()), "profile string, first long")
    by_part = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts_each)))
    totals = by_part.groupBy("profile", "part").agg(F.sum("piece").alias("n"))
    offsets = totals.withColumn("offset", F.sum("n").over(Window.partitionBy("profile").orderBy("part")) - F.col("n")).drop("n")
    run = F.sum("piece").over(Window.partitionBy("profile", "part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("piece")
    split = (
        by_part.withColumn("run", run)
        .join(offsets, ["profile", "part"])
        .join(F.broadcast(first), "profile")
        .select("profile", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("piece") - 1)).alias("at"), "capacity", (F.col("first") + F.col("offset") + F.col("run")).alias("base"))
        .select("profile", "doc_id", F.col("at").alias("piece"), F.col("capacity").cast("long").alias("tokens"), (F.col("base") + F.col("at")).alias("container"))
    )
    nothing = sizes.where("tokens <= 0").crossJoin(limits).select("profile", "doc_id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("tokens"), F.lit(None).cast("long").alias("container"))
    return packed.unionByName(split).unionByName(nothing)


def fill_report(packed: DataFrame, profiles: list[tuple[str, int]]) -> DataFrame:
    """Per profile: containers, tokens and the share of their room that is used."""
    limits = packed.sparkSession.createDataFrame(profiles, "profile string, capacity int")
    totals = packed.where("container is not null").groupBy("profile").agg(F.sum("tokens").alias("tokens"), (F.max("container") + 1).alias("containers"))
    return totals.join(F.broadcast(limits), "profile").select("profile", "capacity", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("filled"))
