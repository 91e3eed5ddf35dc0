"""The event log as a stream: windows, sessions, matching, and state per memory.

Each function takes a streaming (or static) table of events and returns one. ``drain`` runs a stream over what is
there, to its end, and gives the result as a static table.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mnemospark.config import SCORING
from mnemospark.runtime import shared_folder

STATE = "ewma double, count long"
RESULT = "memory_id string, ewma double, count long"


def event_stream(spark: SparkSession, folder: str, name: str = "memory_events") -> DataFrame:
    """A table's files as a stream, read one after the other."""
    path = os.path.join(folder, f"{name}.parquet")
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", "4")
    if os.path.isdir(path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def timed(events: DataFrame, lateness: str = "30 days") -> DataFrame:
    """Events with a time, as a time with zone (UTC), each id once within the watermark."""
    whole = events.where("created_at is not null and id is not null").withColumn("created_at", F.col("created_at").cast("timestamp"))
    kept = whole.withWatermark("created_at", lateness)
    return kept.dropDuplicatesWithinWatermark(["id"]) if events.isStreaming else kept.dropDuplicates(["id"])


def daily_counts(events: DataFrame) -> DataFrame:
    """(day, event_type, events): tumbling windows of a day."""
    return events.groupBy(F.window("created_at", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "events")


def sliding_retrievals(events: DataFrame, width: str = "30 days", step: str = "10 days") -> DataFrame:
    """(start, memories, events): retrievals over sliding windows. Of a stream the memories are counted approximately, as streams keep no distinct counts."""
    seen = events.where("event_type = 'retrieved'")
    memories = F.approx_count_distinct("memory_id", 0.02) if events.isStreaming else F.count_distinct("memory_id")
    return seen.groupBy(F.window("created_at", width, step).alias("w")).agg(memories.alias("memories"), F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("start"), "memories", "events")


def bursts(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(session_id, start, end, events): a session's events, cut where it rests for longer than the gap."""
    whole = events.where("session_id is not null")
    return whole.groupBy("session_id", F.session_window("created_at", gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def open_bursts(events: DataFrame, watermark: str, gap: str = "30 minutes") -> DataFrame:
    """The bursts that a stream of these events leaves open at its last watermark, from the events (once each) as a static table.

    An open burst ends after the watermark. Sessions without an event later than the watermark less the gap have none; of the others all bursts are formed.
    """
    late = events.where(F.col("created_at") > F.expr(f"timestamp '{watermark}' - interval {gap}")).select("session_id").distinct()
    return bursts(events.join(late, "session_id", "left_semi"), gap).where(F.col("end") > F.expr(f"timestamp '{watermark}'"))


def matches(feedback: DataFrame, recalls: DataFrame, within: str = "60 seconds") -> DataFrame:
    """(feedback_id, recall_id, gap): ratings with the recalls of their session up to a minute before, as a join of two streams."""
    left = feedback.where("event_type = 'feedback' and session_id is not null").select(F.col("id").alias("feedback_id"), F.col("session_id").alias("s"), F.col("created_at").alias("rated_at"))
    right = recalls.where("event_type = 'recall_meta' and session_id is not null").select(F.col("id").alias("recall_id"), "session_id", F.col("created_at").alias("recalled_at"))
    joined = left.join(right, F.expr(f"s = session_id and rated_at >= recalled_at and rated_at <= recalled_at + interval {within}"))
    return joined.select("feedback_id", "recall_id", ((F.unix_micros("rated_at") - F.unix_micros("recalled_at")) / 1e6).alias("gap"))


def _update(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    ewma, count = state.get if state.exists else (0.0, 0)
    for u in pd.concat(batches).sort_values(["created_at", "id"]).utility:
        ewma = u if count == 0 else SCORING.ewma_alpha * u + (1 - SCORING.ewma_alpha) * ewma
        count += 1
    state.update((float(ewma), int(count)))
    yield pd.DataFrame({"memory_id": [key[0]], "ewma": [float(ewma)], "count": [int(count)]})


def smoothed_utility(events: DataFrame) -> DataFrame:
    """(memory_id, ewma, count) after each batch of ratings: two numbers of state per memory, in order of arrival.

    Within a batch ratings are ordered by time, then id.
    """
    utility = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.get_json_object("context", "$.utility").try_cast("double"), F.lit(0.0))))
    rated = events.where("event_type = 'feedback' and memory_id is not null").select("memory_id", "created_at", "id", utility.alias("utility"))
    return rated.groupBy("memory_id").applyInPandasWithState(_update, RESULT, STATE, "update", GroupStateTimeout.NoTimeout)


def drain_to_watermark(stream: DataFrame) -> tuple[DataFrame, str]:
    """What a stream in append mode wrote to its end, and the watermark up to which it did."""
    marks: list[str] = []
    return drain(stream, marks=marks), marks[-1]


def drain(stream: DataFrame, mode: str = "append", latest_by: list[str] | None = None, order: str | None = None, marks: list[str] | None = None) -> DataFrame:
    """Run a stream until its source is read, and read what it wrote.

    In update mode the rows of ``latest_by`` with the largest ``order`` are the result. What is written and the
    stream's own checkpoints lie in the shared checkpoint folder. The watermark of the last batch is added to ``marks``.
    """
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "update":
        write = stream.writeStream.foreachBatch(lambda df, n: df.withColumn("__batch", F.lit(n)).write.mode("append").parquet(f"{at}/out")).outputMode("update")
    else:
        write = stream.writeStream.format("parquet").option("path", f"{at}/out").outputMode("append")
    query = write.option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if marks is not None:
        last = query.lastProgress
        marks.append((last["eventTime"].get("watermark") if last else None) or "1970-01-01T00:00:00.000Z")
    extra = [T.StructField("__batch", T.LongType())] if mode == "update" else []
    done = spark.read.schema(T.StructType([*stream.schema.fields, *extra])).parquet(f"{at}/out")
    if mode == "update" and latest_by:
        rest = [c for c in stream.columns if c not in latest_by]
        return done.groupBy(*latest_by).agg(F.max_by(F.struct(*rest), F.struct(*([order] if order else []), "__batch")).alias("r")).select(*latest_by, "r.*")
    return done
