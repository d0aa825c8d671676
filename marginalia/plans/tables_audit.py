"""The audit over the tables instead of a tree: the same detectors, fed with the same relations."""

from __future__ import annotations

from dataclasses import replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia import catalogue
from marginalia.functions import text, urls
from marginalia.operators import blocks as block_ops
from marginalia.operators import copies, pairing, paths
from marginalia.operators.skew import large
from marginalia.plans import blocks as block_plans
from marginalia.plans import content
from marginalia.plans.audit import ABOUT_COPIES, Audit
from marginalia.session import written
from marginalia.settings import Settings
from marginalia.sources import tree
from marginalia.sources.tables import table

#: Found by looking links up on the network, which the tables have no results of.
LINK_PROBLEMS = ("dead-link", "dead-image", "missing-fragment", "moved-link", "moved-link-review", "temporary-redirect", "unreachable-link")
#: The contradictions between a command and its output, one problem in the ledger.
WARNINGS = ("digest-mismatch", "image-mismatch", "tag-mismatch")
#: Problems that are judged; the warnings are under cross-reference.
JUDGED = tuple(p for p in catalogue.FINDINGS if p not in (*LINK_PROBLEMS, *WARNINGS))
ANOMALIES = ("missing-code-element", "missing-lang", "unescaped-markup")


def _last(df: DataFrame, key: str, *by: str) -> DataFrame:
    order = [F.desc_nulls_last(c) for c in by]
    return df.withColumn("n_", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("n_ = 1").drop("n_")


class TablesAudit(Audit):
    """No relation is kept in memory: those used often are written once to the shared folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.settings = Settings(
            root=Path(sf_dir), ledger=Path(sf_dir), primary_domain="", registry_prefixes=(), non_image_namespaces=(), stale_image_days=1, languages={}, allowed_private=(), anomalies=ANOMALIES, owned_domains=(), skip=(),
            stale_budget=0, min_words=copies.MIN_WORDS, shingle_size=copies.RUN, threshold=copies.THRESHOLD, ignore_elements=(), terms=content.TERMS,
        )
        self._copies: DataFrame | None = None
        self._findings: DataFrame | None = None
        self.courses = self._courses()
        named = tree.items(self.courses)
        self.files = table(spark, sf_dir, "content_files", "path").distinct().join(large(content.files(spark, sf_dir)), "path", "left")
        self.resolved = written(paths.resolved(named, self.files.select("path")))
        pages = self.files.where("html is not null").select(F.col("path").alias("found"), "html")
        self.items = written(self.resolved.where("found is not null").join(pages, "found").withColumn("base", F.concat_ws("/", "course_dir", "lesson_slug", "item_id")))
        self.blocks = self._blocks()

    def _courses(self) -> DataFrame:
        """One row a course, in the shape of `tree.courses`."""
        spark, sf_dir = self.spark, self.sf_dir
        df = _last(table(spark, sf_dir, "courses", "course_dir", "title", "short_description", "long_description_html", "domains", "ingested_at"), "course_dir", "ingested_at", "title")
        doc = F.to_json(F.struct("title", F.struct("short_description", F.array("long_description_html").alias("html")).alias("details")))
        slugs = F.map_filter(F.transform_values("domains", lambda _, d: d["slug"]), lambda _, s: s.isNotNull())
        lists = table(spark, sf_dir, "course_urls", "index_id", "taken_at", "urls").select("index_id", "taken_at", F.explode("urls").alias("course_dir", "url"))
        last = lists.groupBy("course_dir").agg(F.max_by("url", F.struct("taken_at", "index_id")).alias("url"))
        meta = _last(table(spark, sf_dir, "lessons_meta"), "lesson_id", "updated_at", "ingested_at")
        item = F.transform("content_items", lambda i: F.struct(i["id"].alias("id"), i["file"].alias("file"), i["sort_order"].alias("order")))
        lesson = F.struct(F.col("lesson_id").alias("id"), "slug", "title", F.col("sort_order").alias("order"), "description_html", F.filter(item, lambda i: i["file"].rlike(r"\S")).alias("content_items"))
        lessons = meta.groupBy("course_dir").agg(F.collect_list(lesson).alias("lessons"))
        df = df.select("course_dir", F.coalesce("title", "course_dir").alias("title"), F.struct("title", "short_description", "long_description_html").alias("details"), doc.alias("details_doc"), F.to_json(F.struct("domains")).alias("published_doc"), slugs.alias("slugs"))
        return written(df.join(large(lessons), "course_dir", "full").join(large(last), "course_dir", "left"))

    def _blocks(self) -> DataFrame:
        rows = block_plans.classified(self.spark, self.sf_dir, "block_id", "raw_code", "anomalies", "src_file", "src_line", *block_plans.ITEM, "ordinal")
        meta = _last(table(self.spark, self.sf_dir, "lessons_meta", "course_dir", "slug", "updated_at").withColumn("at", F.concat_ws("/", "course_dir", "slug")), "at", "updated_at").join(self.courses.select("course_dir", F.col("url").alias("course_url")), "course_dir")
        meta = meta.select("course_dir", F.col("slug").alias("lesson_slug"), urls.lesson_url("course_url", "slug").alias("lesson_url"))
        rows = rows.join(large(meta), ["course_dir", "lesson_slug"], "left").withColumn("lang", F.coalesce("lang", F.lit(""))).withColumn("fingerprint", text.fingerprint("code"))
        rows = rows.withColumn("editor_ref", F.concat_ws(":", "src_file", F.coalesce("src_line", F.lit(1)), F.lit(1)))
        return written(pairing.linked(rows, block_plans.ITEM))

    def _seen(self) -> DataFrame:
        return table(self.spark, self.sf_dir, "text_docs", F.col("text_id").alias("id"), "text", F.regexp_replace("editor_ref", r":\d+:\d+$", "").alias("found"), "lesson_url")

    def unused_lang(self) -> DataFrame:
        none = F.lit(None).cast("string")
        df = block_plans.unused_lang(self.spark, self.sf_dir)
        return df.select(F.lit("unused-lang").alias("problem"), F.col("lang").alias("key"), none.alias("fingerprint"), F.col("lang").alias("match"), none.alias("editor_ref"), none.alias("url"))

    def term_findings(self) -> list[DataFrame]:
        """Names in texts and in slugs have lists of their own here."""
        own, out = self.settings, []
        for place, terms in enumerate((content.TERMS, content.SLUG_TERMS)):
            self.settings = replace(own, terms=terms)
            out.append(super().term_findings()[place])
        self.settings = own
        return out

    def siblings(self, judged: DataFrame) -> DataFrame:
        """`copies.sibling_findings` of the findings with state and file that aren't about copies themselves."""
        rows = judged.where(~F.col("problem").isin(*ABOUT_COPIES) & F.col("file").isNotNull())
        return copies.sibling_findings(rows.withColumn("accepted", F.col("state") == "accepted"), self.sibling_files())

    def sibling_files(self) -> DataFrame:
        of = large(self._seen().select("id", "found"))
        pairs = self.copies().select("a", "b").join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b")
        return copies.sibling_files(pairs.select(F.col("x").alias("a"), F.col("y").alias("b")))

    def rows(self) -> DataFrame:
        """(problem, key, whole, fingerprint, file) of all findings; whole is the key without the rule."""
        df = self.findings().withColumn("problem", F.when(F.col("problem").isin(*WARNINGS), "cross-reference").otherwise(F.col("problem")))
        df = df.withColumn("file", F.regexp_replace("editor_ref", r":\d+:\d+$", "")).withColumn("whole", F.regexp_replace("key", r"^([^\s:]+#[^\s:]+)::.*$", "$1"))
        return df.select("problem", "key", "whole", "fingerprint", "file").dropDuplicates(["problem", "key"])


def sibling_rows(siblings: DataFrame, states: DataFrame) -> DataFrame:
    """(problem, key, whole, fingerprint, file) of `sibling_findings` as findings: the key names the finding and both files."""
    prints = states.groupBy(F.col("problem").alias("of"), "file", (F.col("state") == "accepted").alias("done")).agg(F.min("fingerprint").alias("fingerprint"))
    df = siblings.select(F.col("problem").alias("of"), F.col("rule").alias("problem"), "file", "twin").withColumn("done", F.col("problem") == "half-accepted-copy")
    accepted: Column = F.when(F.col("done"), " accepted ").otherwise(" ")
    df = df.join(prints, ["of", "file", "done"]).withColumn("key", F.concat("of", accepted, copies.pair_key(F.col("file"), F.col("twin"))))
    return df.select("problem", "key", F.col("key").alias("whole"), "fingerprint", "file").dropDuplicates(["problem", "key"])
