"""Items that appear together: pair counts, lift and pointwise mutual information over baskets.

Equal baskets are folded into one row with a weight before any pair is made: a recall that returned m memories
writes m records with the same items, so this saves a factor of m in pairs without changing a count. Ordered pairs
(a < b) are then emitted once per distinct basket and their weights added, first within each map task, then after
the shuffle. Items that are rarer than ``min_joint`` are left out before, which is exact. Only pairs that reach it meet the marginals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.runtime import checkpoint

#: Items of a basket are paired in blocks of this many, so that one huge basket is spread over many tasks.
BLOCK = 256


def baskets_of(records: DataFrame, record: str, items: Column) -> DataFrame:
    """(items, weight): distinct baskets with the number of distinct records that have them.

    Items are the distinct non-null entries, sorted. Records repeat: a record id counts once, with the smallest of
    its baskets should its copies differ. Records without an id are dropped; records without items still count (their
    basket is empty). Baskets are told apart by two independent 64-bit hashes.
    """
    clean = F.array_sort(F.array_distinct(F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x.isNotNull())))
    rows = records.where(F.col(record).isNotNull()).select(F.col(record).alias("record"), clean.alias("items"))
    rows = rows.withColumn("key", F.struct(F.xxhash64("items").alias("a"), F.xxhash64(F.lit(7), "items").alias("b")))
    weights = rows.groupBy("record").agg(F.min("key").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("weight"))
    content = rows.groupBy("key").agg(F.first("items").alias("items"))
    return weights.join(content, "key").select("items", "weight")


def _pairs(baskets: DataFrame) -> DataFrame:
    """(a, b, weight) for every pair of items of every basket."""
    size = F.size("items")
    small = baskets.where(size <= BLOCK).select(F.col("items").alias("left"), F.lit(None).cast("array<string>").alias("right"), "weight")
    # Blocks i <= j of a large basket; each pair of blocks is a row of its own and goes to any task.
    cut = baskets.where(size > BLOCK).withColumn("blocks", F.transform(F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int")), lambda i: F.slice("items", i * BLOCK + 1, F.lit(BLOCK))))
    one = cut.select(F.posexplode("blocks").alias("i", "left"), "blocks", "weight")
    large = one.select("left", F.explode(F.slice("blocks", F.col("i") + 1, F.size("blocks"))).alias("right"), "weight").repartition(F.xxhash64("left", "right"))  # by content, so that a task that runs again deals alike
    large = large.select("left", F.when(F.col("left") != F.col("right"), F.col("right")).alias("right"), "weight")
    firsts = small.unionByName(large).select(F.posexplode("left").alias("at", "a"), "left", "right", "weight")
    rest = F.coalesce("right", F.slice("left", F.col("at") + 2, F.size("left")))
    return firsts.select("a", F.explode(rest).alias("b"), "weight")


def pair_association(baskets: DataFrame, min_joint: int = 1, min_lift: float = 0.0) -> DataFrame:
    """``item_a < item_b, n_a, n_b, n_ab, n_records, lift, pmi`` of the pairs with enough joint records.

    lift is n_ab * N / (n_a * n_b) and pmi its base-2 logarithm. An empty input gives an empty result; baskets of one
    item or none only count towards N. Ties and repeated rows need no rule, as every number is a count.
    """
    baskets = checkpoint(baskets)  # read by three jobs
    single = checkpoint(baskets.select(F.explode("items").alias("item"), "weight").groupBy("item").agg(F.sum("weight").alias("n")).where(F.col("n") >= min_joint))
    # A pair can't be more frequent than either item, so rare items leave their baskets before pairs are made.
    key = [F.xxhash64("items").alias("one"), F.xxhash64(F.lit(7), "items").alias("two")]
    paired = baskets.where(F.size("items") > 1).select(*key, "weight", F.explode("items").alias("item")).join(single.select("item"), "item", "left_semi")
    frequent = paired.groupBy("one", "two", "weight").agg(F.array_sort(F.collect_list("item")).alias("items")).where(F.size("items") > 1).select("items", "weight")
    joint = _pairs(frequent).groupBy("a", "b").agg(F.sum("weight").alias("n_ab")).where(F.col("n_ab") >= min_joint)
    total = baskets.agg(F.sum("weight").alias("n_records"))
    found = (
        joint.join(single.select(F.col("item").alias("a"), F.col("n").alias("n_a")), "a")
        .join(single.select(F.col("item").alias("b"), F.col("n").alias("n_b")), "b")
        .crossJoin(F.broadcast(total))  # one row
    )
    lift = F.col("n_ab") * F.col("n_records") / (F.col("n_a").cast("double") * F.col("n_b"))
    return (
        found.withColumn("lift", lift)
        .where(F.col("n_ab") * F.col("n_records") >= F.lit(min_lift) * F.col("n_a") * F.col("n_b"))
        .select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), "n_a", "n_b", "n_ab", "n_records", "lift", F.log2("lift").alias("pmi"))
    )
