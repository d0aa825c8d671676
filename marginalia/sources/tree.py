"""Reading of a tree of published content: courses/<dir>/*.json and courses/<dir>/lessons/<slug>/*.html.

Files are read whole, in parallel, with their paths. Schemas are given; a file that isn't JSON fails the read, a missing one
leaves nulls.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import urls

DETAILS = "id string, title string, short_description string, long_description_html string"
PUBLISHED = "course_id string, domains map<string, struct<slug: string, published_course_id: string, hidden: boolean>>"
LESSONS = "array<struct<id: string, slug: string, title: string, order: int, description_html: string, content_items: array<struct<id: string, file: string, order: int>>>>"
INDEX = "description string, urls map<string, string>"


def _path(root: str) -> Column:
    """Path below the root, wherever that lies."""
    full = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    base = re.sub(r"^[a-z]+:/*(?=/)", "", root.rstrip("/"))
    return F.substring(full, F.instr(full, F.lit(f"{base}/courses/")) + len(base) + 1, F.length(full))


def whole_files(spark: SparkSession, root: str, pattern: str, name: str) -> DataFrame:
    """(path, <name>) of the files of a pattern below the root; none gives no rows."""
    df = spark.read.text(f"{root}/courses", wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return df.select(_path(root).alias("path"), F.col("value").alias(name))


def _json(spark: SparkSession, root: str, name: str, schema: str, column: str) -> DataFrame:
    df = whole_files(spark, root, name, "doc").where(F.col("path").rlike(rf"^courses/[^/]+/{name}$"))
    return df.select(F.split("path", "/")[1].alias("course_dir"), F.from_json("doc", schema, {"mode": "FAILFAST"}).alias(column), F.col("doc").alias(f"{column}_doc"))


def course_index(spark: SparkSession, root: str) -> DataFrame:
    """(course_dir, url) of the index of public addresses."""
    df = whole_files(spark, root, "course-urls.json", "doc").where("path = 'courses/course-urls.json'")
    return df.select(F.explode(F.from_json("doc", INDEX, {"mode": "FAILFAST"})["urls"]).alias("course_dir", "url"))


def courses(spark: SparkSession, root: str) -> DataFrame:
    """One row a course: its metadata documents joined on the directory; the title falls back to the directory."""
    details, published, lessons = _json(spark, root, "details.json", DETAILS, "details"), _json(spark, root, "published.json", PUBLISHED, "published"), _json(spark, root, "lessons-meta.json", LESSONS, "lessons")
    df = details.join(published, "course_dir", "full").join(lessons, "course_dir", "full").join(course_index(spark, root), "course_dir", "left")
    slugs = F.map_filter(F.transform_values("published.domains", lambda _, d: d["slug"]), lambda _, s: s.isNotNull())
    return df.select("course_dir", F.coalesce("details.title", "course_dir").alias("title"), "url", "details", "details_doc", "published_doc", slugs.alias("slugs"), "lessons")


def items(courses_df: DataFrame) -> DataFrame:
    """One row for each content item: (course_dir, course_url, lesson_slug, item_id, path, lesson_url)."""
    df = courses_df.select("course_dir", F.col("url").alias("course_url"), F.explode("lessons").alias("lesson"))
    df = df.select("course_dir", "course_url", F.col("lesson.slug").alias("lesson_slug"), F.explode("lesson.content_items").alias("item"))
    return df.select(
        "course_dir",
        "course_url",
        "lesson_slug",
        F.col("item.id").alias("item_id"),
        F.concat(F.lit("courses/"), "course_dir", F.lit("/"), "item.file").alias("path"),
        urls.lesson_url("course_url", "lesson_slug").alias("lesson_url"),
    )


def pages(spark: SparkSession, root: str) -> DataFrame:
    return whole_files(spark, root, "*.html", "html")
