"""Small helpers about the running session."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; a temporary one where a session on one machine names none (tests).

    On a cluster a machine's own folder is seen by no other, so there a missing name is an error.
    """
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def squash(text: Column) -> Column:
    """Lower case without surrounding white space."""
    return F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))
