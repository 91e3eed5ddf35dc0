"""Queries over the succession of memories (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators.hierarchy import descendants, parent_links, resolve_hierarchy
from mnemospark.sources.tables import table


def _resolved(spark: SparkSession, folder: str, with_paths: bool = True) -> DataFrame:
    return resolve_hierarchy(parent_links(table(spark, folder, "memories")), with_paths)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _resolved(spark, folder, with_paths=False).select(F.col("node").alias("memory_id"), F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"))


def p6_paths(spark: SparkSession, folder: str) -> DataFrame:
    return _resolved(spark, folder).select(F.col("node").alias("memory_id"), F.array_join("path", ">").alias("path"), "on_cycle")


def p6_descendants(spark: SparkSession, folder: str) -> DataFrame:
    found = descendants(_resolved(spark, folder))
    return found.select(F.col("ancestor").alias("memory_id"), F.col("node").alias("replaced_id"), F.col("distance").cast("int").alias("distance"))


QUERIES = {"p6_found": p6_found, "p6_paths": p6_paths, "p6_descendants": p6_descendants}

_WALK = """
WITH RECURSIVE l AS (
  SELECT m.id AS node, min(m.superseded_by) AS parent FROM memories m
  WHERE m.superseded_by IN (SELECT id FROM memories) GROUP BY m.id),
walk(node, cur, d, seen) AS (
  SELECT node, parent, 1, [node] FROM l
  UNION ALL
  SELECT w.node, l.parent, w.d + 1, list_append(w.seen, w.cur) FROM walk w JOIN l ON w.cur = l.node
  WHERE NOT list_contains(w.seen, w.cur)),
ends AS (SELECT *, list_contains(seen, cur) AS circle FROM walk
  WHERE list_contains(seen, cur) OR cur NOT IN (SELECT node FROM l))
"""

SQL = {
    "p6_found": _WALK
    + """SELECT node AS memory_id,
      CASE WHEN circle THEN list_min(list_slice(seen, list_position(seen, cur), len(seen))) ELSE cur END AS root_id,
      CASE WHEN circle THEN -1 ELSE d END::INTEGER AS depth FROM ends""",
    "p6_paths": _WALK
    + """SELECT node AS memory_id,
      CASE WHEN NOT circle THEN array_to_string(list_append(list_slice(seen, 2, len(seen)), cur), '>') END AS path,
      circle AND cur = node AS on_cycle FROM ends""",
    "p6_descendants": _WALK
    + """SELECT cur AS memory_id, node AS replaced_id, d::INTEGER AS distance FROM walk
      WHERE node IN (SELECT node FROM ends WHERE NOT circle)""",
}
