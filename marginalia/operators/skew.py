"""Joins of more rows than the planner takes them for, and on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot with more rows than HOT and than one of MOST parts of all rows, so that there are fewer than MOST hot keys.
HOT = 100_000
MOST = 10_000
PARTS = 64


def large(df: DataFrame) -> DataFrame:
    """The rows, to be joined by sorting only. The planner guesses sizes from those of compressed files and takes a row for one row
    however many it is exploded into; by such a guess it would build any number of rows in the driver to send them to all executors."""
    return df.hint("merge")


def hot_keys(sizes: DataFrame, keys: Sequence[str], size: str, hot: int = HOT) -> DataFrame | None:
    """The hot keys of (keys, size), a list of fewer than MOST rows; None if there is none. `sizes` is read once, and again if there are."""
    total, most = sizes.agg(F.sum(size), F.max(size)).first()
    least = max(hot, (total or 0) / MOST)
    if (most or 0) <= least:
        return None
    rows = sizes.where(F.col(size) > least).select(*keys).collect()
    return sizes.sparkSession.createDataFrame(rows, sizes.select(*keys).schema)


def split_join(left: DataFrame, right: DataFrame, keys: Sequence[str], by: str, hot: DataFrame | None, parts: int = PARTS) -> DataFrame:
    """The inner join of left with right; left rows of a hot key are dealt into parts by their column `by`, and meet a copy of the right rows in each."""
    if hot is None:
        return left.join(right, list(keys))
    marks = F.broadcast(hot.withColumn("hot_", F.lit(True)))
    dealt = F.when(F.col("hot_"), F.pmod(F.xxhash64(by), F.lit(parts))).otherwise(0).cast("int")
    copies = F.when(F.col("hot_"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    one = left.join(marks, list(keys), "left").withColumn("part_", dealt).drop("hot_")
    two = right.join(marks, list(keys), "left").withColumn("part_", F.explode(copies)).drop("hot_")
    return large(one).join(two, [*keys, "part_"]).drop("part_")  # a hint on `left` holds for its join with the marks alone
