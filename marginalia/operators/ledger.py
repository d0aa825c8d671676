"""Findings against the ledger of accepted issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.skew import large

KEY = ("problem", "key")


def latest(issues: DataFrame) -> DataFrame:
    """One row for each problem and key: the last one added (ties: the greatest fingerprint and note)."""
    by = Window.partitionBy(*KEY).orderBy(F.desc_nulls_last("added"), F.desc_nulls_last("fingerprint"), F.desc_nulls_last("note"))
    return issues.withColumn("n_", F.row_number().over(by)).where("n_ = 1").drop("n_")


def applied(findings: DataFrame, issues: DataFrame) -> DataFrame:
    """Findings (problem, key, fingerprint, ...) with state: accepted if the ledger has them with this fingerprint or none,
    stale if with another (the finding is open again), else open."""
    entries = latest(issues).select(*KEY, F.col("fingerprint").alias("accepted_fingerprint_"), F.lit(True).alias("listed_"))
    df = findings.join(large(entries), list(KEY), "left")
    same = F.col("accepted_fingerprint_").isNull() | F.col("accepted_fingerprint_").eqNullSafe(F.col("fingerprint"))
    state = F.when(F.col("listed_").isNull(), "open").when(same, "accepted").otherwise("stale")
    return df.withColumn("state", state).drop("accepted_fingerprint_", "listed_")


def unmatched(issues: DataFrame, findings: DataFrame) -> DataFrame:
    """Entries of the ledger without a finding."""
    return latest(issues).join(large(findings.select(*KEY).distinct()), list(KEY), "left_anti")


def key_shape(key: Column) -> dict[str, Column]:
    """course, slug and rest of a key."""
    pattern = r"^([^/]+)/([^/]+)/(.*)$"
    return {name: F.nullif(F.regexp_extract(key, pattern, i), F.lit("")) for i, name in enumerate(("course", "slug", "rest"), 1)}


def renamed(issues: DataFrame, findings: DataFrame) -> DataFrame:
    """Unmatched entries with new_key: the first open finding of the problem that differs from the entry in its slug alone;
    null if there is none, that is if the issue was resolved."""
    left = unmatched(issues, findings)
    left = left.withColumns({f"{n}_": c for n, c in key_shape(F.col("key")).items()})
    open_ = applied(findings, issues).where("state = 'open'").select("problem", F.col("key").alias("found_"))
    open_ = open_.withColumns({f"{n}_": c for n, c in key_shape(F.col("found_")).items()}).withColumnRenamed("slug_", "other_")
    met = left.join(large(open_), ["problem", "course_", "rest_"]).where("slug_ <> other_").groupBy(*KEY).agg(F.min("found_").alias("new_key"))
    return left.drop("course_", "slug_", "rest_").join(large(met), list(KEY), "left")


def unknown(issues: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Entries whose problem the catalogue doesn't have."""
    return issues.join(catalogue.select(F.col("id").alias("problem")), "problem", "left_anti")
