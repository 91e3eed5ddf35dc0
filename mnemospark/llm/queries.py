"""The registered queries of this folder, with SQL twins where SQL can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm.canonical import is_blank, map_to_canonical
from mnemospark.llm.components import connected_components
from mnemospark.llm.cooccurrence import baskets_of, pair_association
from mnemospark.llm.encoding import repair_encoding
from mnemospark.llm.mixing import mix_report, mix_sources
from mnemospark.llm.neighbours import most_similar
from mnemospark.llm.packing import fill_report, pack
from mnemospark.llm.pii import items_of_rows, redact
from mnemospark.llm.tokens import with_token_counts
from mnemospark.runtime import squash
from mnemospark.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of memories at least 0.8 similar, one of which is among the ten most similar of the other."""
    vectors = table(spark, folder, "memory_vec").select(F.col("memory_id").alias("id"), F.col("embedding").alias("vector"))
    near = most_similar(vectors, k=10, min_cosine=0.8)
    return near.select(F.least("id", "neighbour").alias("memory_id_a"), F.greatest("id", "neighbour").alias("memory_id_b")).distinct()


def _free_texts(spark: SparkSession, folder: str) -> DataFrame:
    memories = table(spark, folder, "memories").select(F.lit("content").alias("source_field"), F.col("id").alias("record_key"), F.col("content").alias("text"))
    events = table(spark, folder, "memory_events").select(F.lit("query").alias("source_field"), F.col("id").cast("string").alias("record_key"), F.col("query").alias("text"))
    return memories.unionByName(events).where("record_key is not null")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Personal items in memory contents and event queries."""
    return items_of_rows(_free_texts(spark, folder))


def p2_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that hold personal items, with placeholders in their place."""
    return redact(_free_texts(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of memories returned together at least 15 times and 5 times as often as chance would have it."""
    events = table(spark, folder, "memory_events").where("event_type = 'retrieved'")
    items = F.concat(F.array("memory_id"), F.coalesce("co_memory_ids", F.array().cast("array<string>")))
    found = pair_association(baskets_of(events, "id", items), min_joint=15, min_lift=5)
    return found.select(F.col("item_a").alias("memory_id_a"), F.col("item_b").alias("memory_id_b"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each freely written theme with the theme it is a writing of, or (none)."""
    canon = table(spark, folder, "theme_canon").select(F.col("theme").alias("entry"))
    raw = table(spark, folder, "memories").select(F.explode("themes").alias("value")).distinct().where(F.col("value").isNotNull() & ~is_blank(F.col("value")))
    found = map_to_canonical(raw.join(canon.select(F.col("entry").alias("value")), "value", "left_anti"), canon)
    return found.select(F.col("value").alias("raw_theme"), F.coalesce("entry", F.lit("(none)")).alias("canon_theme"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Memories linked by duplicate edges, directly or not, under the smallest id of their group."""
    known = table(spark, folder, "memories").select("id").where("id is not null").distinct()
    links = table(spark, folder, "memory_edges").where(squash(F.col("edge_type")) == "duplicate").select("source_id", "target_id").where("source_id <> target_id").distinct()
    links = links.join(known.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(known.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    return connected_components(links, "source_id", "target_id").select(F.col("member").alias("memory_id"), F.col("component").alias("group_id"))


def _profiles(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    rows = table(spark, folder, "pack_limits").select("profile", "capacity").where("profile is not null and capacity > 0").distinct()
    return [(r.profile, r.capacity) for r in rows.orderBy("profile").collect()]  # a short list that doesn't grow


def _targets(spark: SparkSession, folder: str) -> list[tuple[str, float, int]]:
    rows = table(spark, folder, "mix_targets").select("source", "target_share", "max_repeats").where("source is not null").distinct()
    return [(r.source, r.target_share, r.max_repeats) for r in rows.orderBy("source").collect()]  # a short list that doesn't grow


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return pack(with_token_counts(table(spark, folder, "documents").select("doc_id", "text")), _profiles(spark, folder))


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's container for each capacity."""
    return _packed(spark, folder)


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return fill_report(_packed(spark, folder), _profiles(spark, folder))


def _mixed(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(with_token_counts(table(spark, folder, "documents").select("doc_id", "source", "text")), _targets(spark, folder))


def p8_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mixture in order of output."""
    return _mixed(spark, folder)


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual share of each source in the mixture."""
    return mix_report(_mixed(spark, folder), _targets(spark, folder))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents read in the wrong encoding, with the hash of the restored text."""
    found = repair_encoding(table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text"))
    md5 = F.when(F.col("restored") == "", "").otherwise(F.md5(F.col("restored").cast("binary")))
    return found.select(F.col("id").alias("doc_id"), md5.alias("text_md5"))


def p9_restored(spark: SparkSession, folder: str) -> DataFrame:
    """The restored texts; lost ones are left out."""
    found = repair_encoding(table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text"))
    return found.where("restored <> ''").select(F.col("id").alias("doc_id"), F.col("restored").alias("text"))


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_redacted": p2_redacted,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p7_packed": p7_packed,
    "p7_fill": p7_fill,
    "p8_mixed": p8_mixed,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_restored": p9_restored,
}

SQL = {
    "p1_found": """
WITH v AS (SELECT memory_id AS id, min(embedding)::FLOAT[384] AS e FROM memory_vec
    WHERE len(embedding) = 384 AND list_any_value(list_filter(embedding, lambda x: x <> 0)) IS NOT NULL GROUP BY memory_id),
s AS (SELECT a.id AS a, b.id AS b, array_cosine_similarity(a.e, b.e) AS c FROM v a JOIN v b ON a.id <> b.id),
r AS (SELECT a, b FROM s WHERE c >= 0.8 QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 10)
SELECT DISTINCT least(a, b) AS memory_id_a, greatest(a, b) AS memory_id_b FROM r""",
    "p3_found": """
WITH e AS (SELECT id, memory_id, co_memory_ids FROM memory_events WHERE event_type = 'retrieved' AND id IS NOT NULL),
i AS (SELECT DISTINCT id, m FROM (SELECT id, memory_id AS m FROM e UNION ALL SELECT id, unnest(co_memory_ids) FROM e) WHERE m IS NOT NULL),
n AS (SELECT count(DISTINCT id) AS n FROM e),
s AS (SELECT m, count(*) AS n FROM i GROUP BY m),
p AS (SELECT x.m AS a, y.m AS b, count(*) AS n FROM i x JOIN i y ON x.id = y.id AND x.m < y.m GROUP BY ALL HAVING count(*) >= 15)
SELECT p.a AS memory_id_a, p.b AS memory_id_b FROM p JOIN s sa ON sa.m = p.a JOIN s sb ON sb.m = p.b, n
WHERE p.n * n.n >= 5 * sa.n * sb.n""",
    "p5_found": """
WITH RECURSIVE l AS (SELECT DISTINCT source_id AS a, target_id AS b FROM memory_edges
    WHERE lower(regexp_replace(edge_type, '^\\s+|\\s+$', '', 'g')) = 'duplicate' AND source_id <> target_id
      AND source_id IN (SELECT id FROM memories) AND target_id IN (SELECT id FROM memories)),
b AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(x, y) AS (SELECT a, a FROM b UNION SELECT r.x, b.b FROM r JOIN b ON b.a = r.y)
SELECT x AS memory_id, min(y) AS group_id FROM r GROUP BY x""",
}
