"""Verdicts over the results of registry look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400_000


def age_days(created: Column, now: Column) -> Column:
    return F.floor((F.unix_millis(now.cast("timestamp")) - F.unix_millis(created.cast("timestamp"))) / DAY).cast("bigint")


def drift_status(results: DataFrame, now: Column, stale_days: int) -> DataFrame:
    """Results (ref, pinned, current, created) with age_days and status: unknown without a current digest, current if the pin is
    it, stale if the pinned image is `stale_days` old or older, else behind. An unknown age isn't stale."""
    age = F.when(F.col("created").isNotNull(), age_days(F.col("created"), now))
    status = (
        F.when(F.col("current").isNull() | F.col("pinned").isNull(), "unknown")
        .when(F.col("current") == F.col("pinned"), "current")
        .when(F.coalesce(age, F.lit(-1)) >= stale_days, "stale")
        .otherwise("behind")
    )
    return results.withColumn("age_days", age).withColumn("status", status)


def private_images(resolutions: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(offenders, idle): unauthorised images in courses that aren't allowed any, and allowed courses without one.

    resolutions: (ref, status, course_dir); allowed: (course_dir)."""
    private = resolutions.where("status = 'unauthorized'")
    return private.join(allowed, "course_dir", "left_anti").select("course_dir", "ref").distinct(), allowed.join(private, "course_dir", "left_anti").distinct()
