"""Sources mixed to target weights by Pfair scheduling of blocks.

The total is as large as the scarcest source allows, each used at most its number of times. A source's documents,
in a fixed random order and repeated as a whole as often as needed, are cut into blocks of equal size. Block k of a source
of weight w may not start before slot floor(k / w) and has to be done by slot ceil((k + 1) / w); serving the released block
with the earliest deadline keeps every source within one block of its share at any point of the output. The number of
slots is a parameter, so the schedule has a fixed size, whatever the data's; blocks grow instead.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.runtime import checkpoint

SLOTS = 4096
#: Ranges of the random order that are summed apart, so that a source of any size is spread over many tasks.
PARTS = 256


def schedule(weights: dict[str, float], slots: int = SLOTS) -> list[tuple[str, int, int]]:
    """(source, block, slot): earliest deadline first among released blocks, for ``slots`` slots."""
    release = lambda w, k: math.floor(k / w + 1e-9)
    deadline = lambda w, k: math.ceil((k + 1) / w - 1e-9)
    waiting = [(0, deadline(w, 0), s, 0) for s, w in weights.items() if w > 0]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, due, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, k))
        if not ready:
            continue
        _, s, k = heapq.heappop(ready)
        out.append((s, k, slot))
        w = weights[s]
        heapq.heappush(waiting, (max(slot + 1, release(w, k + 1)), deadline(w, k + 1), s, k + 1))
    return out


def mix_sources(sizes: DataFrame, targets: list[tuple[str, float, int]], slots: int = SLOTS, seed: int = 17) -> DataFrame:
    """(slot, source, position, doc_id, copy, tokens) of the selection, for ``sizes`` (doc_id, source, tokens).

    ``targets`` are (source, target_share, max_repeats). Documents of a null or unlisted source, and those without
    tokens, are not used. A target without documents can't be met: its share is spread over the others. Each source
    takes its documents in random but repeatable order, all of them ``copy`` times before any is used again; the last
    document is the one that comes nearest to the target. ``slot`` then position and doc_id give the order of the output.
    """
    spark = sizes.sparkSession
    usable = sizes.where("tokens > 0 and source is not null and doc_id is not null").select("doc_id", "source", F.col("tokens").cast("long").alias("tokens"))
    names = [t[0] for t in targets]
    usable = checkpoint(usable.where(F.col("source").isin(names)).withColumn("order", F.xxhash64("doc_id", F.lit(seed))))
    held = {r.source: int(r.tokens) for r in usable.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}  # one row a source
    present = [(s, w, n) for s, w, n in targets if held.get(s) and w > 0 and n > 0]
    weight = sum(w for _, w, _ in present)
    if not present:
        return spark.createDataFrame([], f"slot int, source string, position long, doc_id {dict(sizes.dtypes)['doc_id']}, copy int, tokens long")
    shares = {s: w / weight for s, w, _ in present}
    total = min(n * held[s] / shares[s] for s, _, n in present)
    # A document belongs to the block that it begins in; a long one runs on through the next blocks of its source,
    # in which then no other begins. So the number of slots doesn't hang on the longest document.
    slots = max(1, min(slots, int(total)))
    block = total / slots
    needs = [(s, shares[s] * total, float(held[s]), min(n, math.ceil(shares[s] * total / held[s] + 1e-9))) for s, _, n in present]
    table = F.broadcast(spark.createDataFrame(needs, "source string, need double, held double, copies int"))

    # Running totals: over ranges of the random order, then within each range.
    part = F.shiftrightunsigned("order", 56).cast("int")
    ranged = usable.withColumn("part", part)
    by_part = ranged.groupBy("source", "part").agg(F.sum("tokens").alias("n"))
    before = by_part.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).drop("n")
    within = Window.partitionBy("source", "part").orderBy(F.shiftleft("order", 8), "order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("run", F.sum("tokens").over(within) - F.col("tokens")).join(F.broadcast(before), ["source", "part"]).join(table, "source")
    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).withColumn("position", (F.col("copy") * F.col("held") + F.col("before") + F.col("run")).cast("long"))
    # The last one is taken if at least half of it belongs to the target.
    chosen = copies.where(F.col("position") + F.col("tokens") / 2 <= F.col("need")).withColumn("block", F.floor(F.col("position") / F.lit(block)).cast("int"))
    plan = F.broadcast(spark.createDataFrame(schedule(shares, slots), "source string, block int, slot int"))  # one row a slot
    last = F.lit(slots)
    return chosen.join(plan, ["source", "block"], "left").select(F.coalesce("slot", last).alias("slot"), "source", "position", "doc_id", "copy", "tokens")


def mix_report(mixed: DataFrame, targets: list[tuple[str, float, int]]) -> DataFrame:
    """Per source: target and actual share of all tokens, documents used, how often one was used at most, slots and deviation.

    ``largest_deviation`` is the most by which the source's tokens, at the end of any slot of the output, differ from its
    actual share of the tokens so far, as a share of all tokens; ``slots`` is the number of slots that documents begin in.
    """
    wanted = mixed.sparkSession.createDataFrame(targets, "source string, target_share double, max_repeats int")
    per_slot = checkpoint(mixed.groupBy("slot", "source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), F.max("copy").alias("copy")))  # at most slots x sources rows
    by_source = per_slot.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("uses").alias("uses"), (F.max("copy") + 1).alias("most_repeats"))
    total = per_slot.agg(F.sum("tokens").alias("total"), F.countDistinct("slot").alias("slots"))
    by_slot = per_slot.groupBy("slot").agg(F.sum("tokens").alias("all"))
    grid = by_slot.crossJoin(F.broadcast(by_source.select("source", F.col("tokens").alias("held"))))
    upto = Window.partitionBy("source").orderBy("slot")
    run = grid.join(per_slot.select("slot", "source", "tokens"), ["slot", "source"], "left").select("source", "held", F.sum(F.coalesce("tokens", F.lit(0))).over(upto).alias("own"), F.sum("all").over(upto).alias("all"))
    off = run.crossJoin(F.broadcast(total)).groupBy("source").agg(F.max(F.abs(F.col("own") - F.col("all") * F.col("held") / F.col("total")) / F.col("total")).alias("largest_deviation"))
    joined = F.broadcast(wanted).join(by_source, "source", "left").join(off, "source", "left").join(F.broadcast(total))  # one row a source
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return joined.select(
        "source", "target_share", "max_repeats", count("tokens"), count("uses"), count("most_repeats"), F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"), "slots", F.coalesce("largest_deviation", F.lit(0.0)).alias("largest_deviation")
    )
