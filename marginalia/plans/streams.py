"""Queries that run as streams over the tables, used up once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.sources.tables import table
from marginalia.streaming import changes


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def stream_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour and kind."""
    events = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = changes.drained(changes.event_counts(events, "ts", "event_type"))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("hour"), "kind", "n", F.round("total", 4).alias("total"))


def stream_course_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Courses that lists name and that don't exist, by signed counts over both streams."""
    lists = _stream(spark, sf_dir, "course_urls").select(F.explode(F.map_keys("urls")).alias("key"), F.lit(1).alias("refs"), F.lit(0).alias("existence"))
    courses = _stream(spark, sf_dir, "courses").where("added_at is not null").select(F.col("course_dir").alias("key"), F.lit(0).alias("refs"), F.when(F.col("deleted_at").isNull(), 1).otherwise(0).alias("existence"))
    counts = lists.unionByName(courses).groupBy("key").agg(F.sum("refs").alias("refs"), F.sum("existence").alias("existence"))
    return changes.drained(counts).where("refs > 0 and existence <= 0").select("key", "refs")


SQL = {
    "stream_event_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_course_orphans": "WITH r AS (SELECT unnest(map_keys(urls)) AS key FROM course_urls) SELECT key, count(*) AS refs FROM r WHERE key NOT IN (SELECT course_dir FROM courses WHERE added_at IS NOT NULL AND deleted_at IS NULL) GROUP BY key",
}
QUERIES = {f.__name__: f for f in (stream_event_counts, stream_course_orphans)}
