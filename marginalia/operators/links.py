"""Verdicts over the results of link checks, and what follows from them."""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import urls

VERDICTS = ("ok", "dead", "unreachable", "fragment", "temporary", "moved", "review")
PROBLEMS = {"fragment": "missing-fragment", "temporary": "temporary-redirect", "unreachable": "unreachable-link", "moved": "moved-link", "review": "moved-link-review"}


def section_paths(known: DataFrame, url: str = "url") -> DataFrame:
    """(host, path) of the addresses above a known one, the root included: their own segments and at least one more follow."""
    rows = known.select(urls.host(url).alias("host"), urls.segments(url).alias("parts")).where("host is not null and size(parts) > 0").distinct()
    prefixes = F.transform(F.sequence(F.lit(0), F.size("parts") - 1), lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/"))
    return rows.select("host", F.explode(prefixes).alias("path")).distinct()


def judged(results: DataFrame, owned: Sequence[str], known: DataFrame) -> DataFrame:
    """Results (url, status, final_url, permanent, fragment_found) with verdict.

    status: ok, not-found or error. final_url is null without a redirect; fragment_found is null if it wasn't checked. A
    permanent redirect between owned domains is moved, unless it ends at a root, or at a section index under another last
    segment; those are for review.
    """
    sections = section_paths(known).withColumn("section_", F.lit(True)).toDF("host_", "path_", "section_")
    df = results.withColumn("final_host_", urls.host("final_url")).withColumn("final_path_", F.array_join(urls.segments("final_url"), "/"))
    df = df.join(sections, (F.col("final_host_") == F.col("host_")) & (F.col("final_path_") == F.col("path_")), "left")
    final = F.col("final_url")
    both_owned = urls.is_owned("url", owned) & urls.is_owned(final, owned)
    renamed = ~F.coalesce(urls.leaf("url"), F.lit("")).eqNullSafe(F.coalesce(urls.leaf(final), F.lit("")))
    verdict = (
        F.when(F.col("status") == "not-found", "dead")
        .when(F.col("status") == "error", "unreachable")
        .when(F.col("fragment_found") == F.lit(False), "fragment")
        .when(final.isNull() | (urls.comparable("url") == urls.comparable(final)), "ok")
        .when(~F.coalesce("permanent", F.lit(False)), "temporary")
        .when(~both_owned, "review")
        .when(F.col("final_path_") == "", "review")
        .when(renamed & F.col("section_").isNotNull(), "review")
        .otherwise("moved")
    )
    return df.withColumn("verdict", verdict).drop("final_host_", "final_path_", "host_", "path_", "section_")


def rewrite_target(url: Column, final_url: Column) -> Column:
    """The destination, with the fragment of the link if it has none of its own."""
    raw = F.regexp_extract(url, "(#.*)$", 1)
    return F.when(F.contains(final_url, F.lit("#")), final_url).otherwise(F.concat(final_url, raw))


def rewrites(judged_links: DataFrame) -> DataFrame:
    """(url, target) of the links that are safe to rewrite."""
    return judged_links.where("verdict = 'moved'").select("url", rewrite_target(F.col("url"), F.col("final_url")).alias("target"))


def problems(judged_links: DataFrame, sites: DataFrame) -> DataFrame:
    """(problem, url, sites, files) of one finding an address, over the places (url, kind, file) that use it.

    A dead address is a finding of its links and another of its images.
    """
    df = judged_links.where("verdict <> 'ok'").select("url", "verdict").join(sites, "url")
    problem = F.when(F.col("verdict") == "dead", F.when(F.col("kind") == "image", "dead-image").otherwise("dead-link"))
    for verdict, name in PROBLEMS.items():
        problem = problem.when(F.col("verdict") == verdict, name)
    return df.withColumn("problem", problem).groupBy("problem", "url").agg(F.count("*").alias("sites"), F.count_distinct("file").alias("files"))


def rewritten_source(source: Column, url: Column, target: Column) -> Column:
    """A source in which the attribute value that is exactly `url` is `target`."""
    out = source
    for quote in ('"', "'"):
        out = F.replace(out, F.concat(F.lit("=" + quote), url, F.lit(quote)), F.concat(F.lit("=" + quote), target, F.lit(quote)))
    return out


def rewritten_text(source: str, edits: Sequence[tuple[str, str]]) -> str:
    """A source in which href and src attributes that are exactly a raw value have its target, blanks around the sign kept."""
    targets = dict(edits)
    pattern = re.compile(r"""(\b(?:href|src)\s*=\s*)(["'])(.*?)\2""", re.I | re.S)
    return pattern.sub(lambda m: m[1] + m[2] + html.escape(targets[m[3]], quote=False) + m[2] if m[3] in targets else m[0], source)


def verdict_counts(judged_links: DataFrame) -> DataFrame:
    """(verdict, links) for each verdict, zeros included."""
    spark = judged_links.sparkSession
    all_ = spark.createDataFrame([(v,) for v in VERDICTS], "verdict string")
    return all_.join(judged_links.groupBy("verdict").agg(F.count("*").alias("links")), "verdict", "left").select("verdict", F.coalesce("links", F.lit(0)).alias("links"))
