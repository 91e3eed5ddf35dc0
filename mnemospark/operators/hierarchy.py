"""Parent-child links of unknown depth resolved by tree contraction.

The links form a graph in which every node has at most one parent. Rounds of *rake* (take off the leaves) and
*compress* (splice out nodes with exactly one child, an independent set of them at a time) shrink any forest to
its roots in O(log n) rounds, whatever its shape: long chains halve by compression, bushy parts vanish by raking.
Each removed node records the node it hung from at that time and the nodes between. The records are then
replayed backwards: a node's root, depth and path follow from those of the node it hung from.

A circle can't be raked away. Compression shrinks it to one node that is its own parent: such a core, which no
round would end, is how a circle shows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.runtime import checkpoint

CYCLE_DEPTH = -1
MAX_ROUNDS = 200


def parent_links(nodes: DataFrame, node: str = "id", parent: str = "superseded_by") -> DataFrame:
    """(node, parent) of every node whose parent is itself a node; one row per node.

    Null and unknown parents make a node a root. Repeated rows count once; should copies of a node name different
    parents, the smallest one that exists holds.
    """
    known = nodes.select(F.col(node).cast("string").alias("parent")).where("parent is not null").distinct()
    links = nodes.select(F.col(node).cast("string").alias("node"), F.col(parent).cast("string").alias("parent")).where(
        "node is not null and parent is not null and parent <> ''"
    )
    return links.distinct().join(known, "parent").groupBy("node").agg(F.min("parent").alias("parent"))


def _draw(node: str, step: int):
    return F.xxhash64(node, F.lit(step))


def resolve_hierarchy(links: DataFrame, with_paths: bool = True) -> DataFrame:
    """Root, depth and path of every node that has a parent.

    ``links`` has one row (node, parent) per node with a parent. Result: ``node, root, depth`` and, if asked for,
    ``path``: the array of successors from the parent to the root, and ``on_cycle``. A node whose path runs into a
    circle has depth -1, the smallest id on the circle as root and a null path; ``on_cycle`` tells the members of the
    circle from the nodes that lead to it. An empty table gives an empty result. A node that is its own parent is a circle of one.

    Every link carries the number of original links it stands for, the smallest id it skipped and, for paths, the
    ids it skipped in order. The hot parent of very many nodes is aggregated on the map side when children are
    counted; in the replay its join partition is one that adaptive execution splits.
    """
    none = F.array().cast("array<string>")
    via = (lambda *parts: F.concat(*parts)) if with_paths else (lambda *parts: none)
    links = checkpoint(links.select("node", "parent"))
    edges = links.select("node", "parent", F.lit(1).alias("steps"), F.lit(None).cast("string").alias("low"), none.alias("via"))
    # A parent without a parent is a root of the forest.
    roots = links.select(F.col("parent").alias("node")).join(links.select("node"), "node", "left_anti").distinct()
    rounds: list[DataFrame] = []
    for step in range(MAX_ROUNDS):
        children = edges.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("children"), F.min("node").alias("child"))
        # Rake: a leaf goes. Compress: v with the only child c goes if it drew more than both c and its parent, so that no
        # neighbour is spliced out together with it.
        drawn = (_draw("node", step) > _draw("child", step)) & (_draw("node", step) > _draw("parent", step))
        spliced = (F.col("children") == 1) & (F.col("child") != F.col("node")) & (F.col("parent") != F.col("node")) & drawn
        marked = edges.join(children, "node", "left").withColumn("fate", F.when(F.col("children").isNull(), "raked").when(spliced, "spliced").otherwise("kept"))
        over = marked.where("fate = 'spliced'").select(
            F.col("child").alias("node"), F.col("node").alias("mid"), F.col("parent").alias("up"), F.col("steps").alias("more"), F.col("low").alias("lower"), F.col("via").alias("rest")
        )
        # Whoever hung from a spliced node now hangs from that node's parent, also a leaf that is raked in the same
        # round: all that goes in a round hangs from what stays.
        moved = checkpoint(
            marked.drop("children", "child").join(over, "node", "left").select(
                "node",
                "fate",
                F.coalesce("up", "parent").alias("parent"),
                (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"),
                F.least("low", "mid", "lower").alias("low"),
                F.when(F.col("mid").isNull(), F.col("via")).otherwise(via("via", F.array("mid"), "rest")).alias("via"),
            )
        )
        rounds.append(moved.where("fate <> 'kept'"))
        edges = moved.where("fate = 'kept'").drop("fate")
        if edges.where("node <> parent").isEmpty():
            break
    else:
        raise RuntimeError(f"the contraction didn't end within {MAX_ROUNDS} rounds")

    # Cores: one node that is its own parent stands for a circle through the nodes it skips.
    no_path = F.lit(None).cast("array<string>")
    top = roots.select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), none.alias("path"))
    parts = [checkpoint(top.unionByName(edges.select("node", F.least("node", "low").alias("root"), F.lit(CYCLE_DEPTH).alias("depth"), no_path.alias("path"))))]
    # Each round's nodes are written once; what they hang from was removed in a later round or never.
    for batch in reversed(rounds):
        parts.append(checkpoint(_replay(batch, reduce(DataFrame.unionByName, parts), with_paths)))
    done = reduce(DataFrame.unionByName, parts)
    found = done.join(links, "node", "left_semi")
    if not with_paths:
        return found.drop("path")
    circles = edges.select(F.explode(F.concat(F.array("node"), "via")).alias("node"), F.lit(True).alias("member"))
    return found.join(circles, "node", "left").withColumn("on_cycle", F.coalesce("member", F.lit(False))).drop("member")


def _replay(batch: DataFrame, done: DataFrame, with_paths: bool) -> DataFrame:
    """The removed nodes of ``batch``, resolved through the nodes they hung from."""
    up = done.select(F.col("node").alias("parent"), "root", F.col("depth").alias("above"), F.col("path").alias("rest"))
    circle = F.col("above") == CYCLE_DEPTH
    path = F.concat("via", F.array("parent"), "rest") if with_paths else F.array().cast("array<string>")
    return batch.join(up, "parent").select(
        "node",
        "root",
        F.when(circle, F.lit(CYCLE_DEPTH)).otherwise(F.col("above") + F.col("steps")).alias("depth"),
        F.when(~circle, path).alias("path"),
    )


def descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor, node, distance): every memory that an ancestor replaced, directly or not; circles have none.

    One row per pair keeps an ancestor of very many nodes out of any single task.
    """
    return resolved.where("depth > 0").select(F.posexplode("path").alias("at", "ancestor"), "node").select("ancestor", "node", (F.col("at") + 1).alias("distance"))
