"""Files that metadata names, against the files there are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.skew import large


def resolved(references: DataFrame, files: DataFrame) -> DataFrame:
    """References (path) with status (exact, case-mismatch, missing) and found: the path itself if it exists, else the least
    one that differs in case alone."""
    there = files.select("path").distinct().withColumn("folded", F.lower("path"))
    exact = there.select("path", F.lit(True).alias("exact_"))
    near = there.groupBy("folded").agg(F.min("path").alias("near_"))
    df = references.join(large(exact), "path", "left").join(large(near), F.lower("path") == F.col("folded"), "left")
    status = F.when(F.col("exact_"), "exact").when(F.col("near_").isNotNull(), "case-mismatch").otherwise("missing")
    found = F.when(F.col("exact_"), F.col("path")).otherwise(F.col("near_"))
    return df.withColumn("status", status).withColumn("found", found).drop("exact_", "near_", "folded")


def unreferenced(references: DataFrame, files: DataFrame) -> DataFrame:
    """(path) of html files that no reference names in any case."""
    named = references.select(F.lower("path").alias("folded")).distinct()
    return files.where(F.lower("path").endswith(".html")).select("path").distinct().join(large(named), F.lower("path") == F.col("folded"), "left_anti")
