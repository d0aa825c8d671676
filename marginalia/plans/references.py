"""Problem 3: references of the domain's tables to records that do not exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators.references import apply_deltas, current_orphans, existence_deltas, orphan_references
from marginalia.session import cut
from marginalia.sources.tables import table


def utc_day(column: str) -> Column:
    """The UTC date of a timestamp, whatever the time zone of the session."""
    return F.date_from_unix_date(F.floor(F.unix_micros(column) / 86_400_000_000).cast("int"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each reference and key it needs."""
    lessons = (
        table(spark, sf_dir, "lessons_meta", "lesson_id", "course_dir", "updated_at", "content_items")
        .select("lesson_id", "course_dir", utc_day("updated_at").alias("day"), F.explode("content_items.file").alias("ref_value"))
        .where(F.col("ref_value").rlike(r"\S"))
        .select(
            F.lit("lessons_meta").alias("src_table"),
            F.col("lesson_id").alias("row_key"),
            "ref_value",
            "day",
            F.lit("path").alias("space"),
            F.lower(F.concat(F.lit("courses/"), "course_dir", F.lit("/"), "ref_value")).alias("key"),
        )
    )
    urls = table(spark, sf_dir, "course_urls", "index_id", "taken_at", "urls").select(
        F.lit("course_urls").alias("src_table"),
        F.col("index_id").alias("row_key"),
        F.explode(F.map_keys("urls")).alias("ref_value"),
        utc_day("taken_at").alias("day"),
        F.lit("course").alias("space"),
        F.col("ref_value").alias("key"),
    )
    bare = F.regexp_replace("ref_value", r"::[^\s:]+$", "")
    issues = (
        table(spark, sf_dir, "known_issues", "issue_id", "key", "added")
        .where("key is not null")
        .select(F.col("issue_id").cast("string").alias("row_key"), F.col("key").alias("ref_value"), F.col("added").alias("day"))
        .withColumn("parts", F.split(bare, " :: "))
        .select(
            F.lit("known_issues").alias("src_table"),
            "row_key",
            "ref_value",
            "day",
            F.when(F.size("parts") > 1, "item").otherwise("block").alias("space"),
            F.explode("parts").alias("key"),
        )
    )
    return lessons.unionByName(urls).unionByName(issues)


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existence deltas of all that can be referenced."""
    files = table(spark, sf_dir, "content_files", "path", "item_key", "added_at", "deleted_at")
    courses = table(spark, sf_dir, "courses", "course_dir", "added_at", "deleted_at")
    blocks = table(spark, sf_dir, "code_blocks", "block_id", "extracted_at", "removed_at")
    added, deleted = utc_day("added_at"), utc_day("deleted_at")
    return (
        existence_deltas(files, "path", F.lower("path"), added, deleted)
        .unionByName(existence_deltas(files, "item", F.col("item_key"), added, deleted))
        .unionByName(existence_deltas(courses, "course", F.col("course_dir"), added, deleted))
        .unionByName(existence_deltas(blocks, "block", F.col("block_id"), utc_day("extracted_at"), utc_day("removed_at")))
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_references(references(spark, sf_dir), targets(spark, sf_dir))


def p3_per_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table and month."""
    return p3_found(spark, sf_dir).groupBy("src_table", "period").agg(F.count("*").alias("orphans"))


def p3_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that are referenced and do not exist after all changes: the state that two batches of deltas have made, first the references, then what exists."""
    refs = references(spark, sf_dir).where("key is not null").select("src_table", "row_key", "ref_value", "space", "key").distinct()
    refs = refs.select("space", "key", F.lit(1).alias("refs"), F.lit(0).alias("existence"))
    lives = targets(spark, sf_dir).select("space", "key", F.lit(0).alias("refs"), "existence")
    state = cut(apply_deltas(refs.limit(0), refs))
    return current_orphans(apply_deltas(state, lives))


_LIVE = """
refs AS (
  SELECT 'lessons_meta' AS src_table, lesson_id AS row_key, f AS ref_value, CAST(updated_at AT TIME ZONE 'UTC' AS DATE) AS day,
         'path' AS space, lower('courses/' || course_dir || '/' || f) AS key
  FROM (SELECT lesson_id, course_dir, updated_at, unnest(content_items).file AS f FROM lessons_meta) WHERE regexp_matches(f, '\\S')
  UNION ALL
  SELECT 'course_urls', index_id, k, CAST(taken_at AT TIME ZONE 'UTC' AS DATE), 'course', k
  FROM (SELECT index_id, taken_at, unnest(map_keys(urls)) AS k FROM course_urls)
  UNION ALL
  SELECT 'known_issues', CAST(issue_id AS VARCHAR), key, added, CASE WHEN contains(key, ' :: ') THEN 'item' ELSE 'block' END,
         unnest(string_split(regexp_replace(key, '::[^\\s:]+$', ''), ' :: '))
  FROM known_issues WHERE key IS NOT NULL),
life AS (
  SELECT 'path' AS space, lower(path) AS key, CAST(added_at AT TIME ZONE 'UTC' AS DATE) AS a, CAST(deleted_at AT TIME ZONE 'UTC' AS DATE) AS d FROM content_files
  UNION ALL SELECT 'item', item_key, CAST(added_at AT TIME ZONE 'UTC' AS DATE), CAST(deleted_at AT TIME ZONE 'UTC' AS DATE) FROM content_files
  UNION ALL SELECT 'course', course_dir, CAST(added_at AT TIME ZONE 'UTC' AS DATE), CAST(deleted_at AT TIME ZONE 'UTC' AS DATE) FROM courses
  UNION ALL SELECT 'block', block_id, CAST(extracted_at AT TIME ZONE 'UTC' AS DATE), CAST(removed_at AT TIME ZONE 'UTC' AS DATE) FROM code_blocks)
"""
_FOUND = f"""
WITH {_LIVE}, found AS (
  SELECT DISTINCT src_table, row_key, ref_value, strftime(day, '%Y-%m') AS period FROM refs
  WHERE day IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM life WHERE life.space = refs.space AND life.key = refs.key AND a <= day AND (d IS NULL OR d > day)))
"""
SQL = {
    "p3_found": _FOUND + "SELECT * FROM found",
    "p3_per_period": _FOUND + "SELECT src_table, period, count(*) AS orphans FROM found GROUP BY ALL",
    "p3_current": f"""
WITH {_LIVE}
SELECT space, key, count(*) AS refs FROM (SELECT DISTINCT src_table, row_key, ref_value, space, key FROM refs WHERE key IS NOT NULL) r
WHERE NOT EXISTS (SELECT 1 FROM life WHERE life.space = r.space AND life.key = r.key AND a IS NOT NULL AND d IS NULL)
GROUP BY ALL""",
}
QUERIES = {"p3_found": p3_found, "p3_per_period": p3_per_period, "p3_current": p3_current}
