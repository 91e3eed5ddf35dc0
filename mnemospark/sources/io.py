"""Files that are no tables: JSON of relevance, JSON lines, snapshots of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The forms in which conversation dates are written.
DATE_FORMS = ("h:mm a 'on' d MMMM, yyyy", "d MMMM, yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")


def read_relevance(spark: SparkSession, path: str) -> DataFrame:
    """(query, memory_id, rel) from files of {"query": {"id": relevance}}; relevance is clamped to 0..1, nulls are dropped."""
    text = spark.read.text(path, wholetext=True)
    by_query = text.select(F.explode(F.from_json("value", "map<string,map<string,double>>")).alias("query", "judged"))
    rows = by_query.select("query", F.explode("judged").alias("memory_id", "rel")).where("rel is not null")
    return rows.withColumn("rel", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("rel"))))


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object per row."""
    df.write.mode("error").option("ignoreNullFields", "false").json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a stated schema; lines that are no JSON are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def conversation_date(text: Column) -> Column:
    """A time from any of the known forms, else the first day of 2023."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(form)) for form in DATE_FORMS], F.lit("2023-01-01").cast("timestamp"))


def write_snapshot(df: DataFrame, folder: str, stamp: str) -> str:
    """Write a table as the snapshot ``stamp`` of a folder; snapshots sort by stamp. Gives the path."""
    path = f"{folder.rstrip('/')}/snapshot={stamp}"
    df.write.mode("overwrite").parquet(path)
    return path


def newest_snapshots(spark: SparkSession, folder: str, keep: int = 3) -> DataFrame:
    """Rows of the newest ``keep`` snapshots, with the column snapshot; columns that came later are null in older ones."""
    rows = spark.read.option("mergeSchema", "true").parquet(folder).withColumn("snapshot", F.col("snapshot").cast("string"))
    newest = rows.select("snapshot").distinct().orderBy(F.desc("snapshot")).limit(keep)
    return rows.join(F.broadcast(newest), "snapshot", "left_semi")  # at most ``keep`` rows
