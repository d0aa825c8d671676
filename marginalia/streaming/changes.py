"""Streams: orphan keys kept up to date from change deltas, and counts of events in windows of time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.operators.references import apply_deltas, current_orphans
from marginalia.session import ensure_checkpoint_dir, remove

EMPTY = "space string, key string, refs bigint, existence bigint"


class OrphanLedger:
    """State (space, key, refs, existence) in a folder that all executors share, one version a batch.

    A batch is added to the last version and written as a new one; a batch that is delivered again rewrites
    its own version from the one before, so that deltas count once.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def version(self, number: int) -> DataFrame:
        if number < 0:
            return self.spark.createDataFrame([], EMPTY)
        return self.spark.read.schema(EMPTY).parquet(f"{self.folder}/version={number}")

    def add(self, deltas: DataFrame, number: int) -> None:
        apply_deltas(self.version(number - 1), deltas).write.mode("overwrite").parquet(f"{self.folder}/version={number}")
        # The version before stays, for a batch that is delivered again; those before it are never read any more.
        if number >= 2:
            remove(self.spark, f"{self.folder}/version={number - 2}")

    def orphans(self, number: int) -> DataFrame:
        return current_orphans(self.version(number))

    def follow(self, deltas: DataFrame, checkpoint: str) -> StreamingQuery:
        """Keep up with a stream of deltas (space, key, refs, existence)."""
        return deltas.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).start()


def event_counts(events: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, kind, n, total) per tumbling window; rows later than the watermark are left out of windows that are closed."""
    by = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), F.col(kind).alias("kind"))
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "kind", "n", "total")


def session_counts(events: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user, start, n) of sessions: runs of a user's events with no gap of `gap` or more."""
    by = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), F.col(user).alias("user"))
    return by.agg(F.count("*").alias("n")).select("user", F.col("s.start").alias("start"), "n")


def drained(stream: DataFrame) -> DataFrame:
    """The complete result of a bounded stream once it is used up: each batch is written to the shared folder by the executors, the last one counts."""
    spark = stream.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    last: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result={number}")
        last[:] = [number]

    query = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    read = spark.read.schema(stream.schema)
    return read.parquet(f"{folder}/result={last[0]}") if last else spark.createDataFrame([], stream.schema)
