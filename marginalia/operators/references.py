"""References without a live target, from signed counts per key.

Every change is a delta: a target that comes to exist counts +1 on the day it is added and -1 on
the day it is deleted; a reference counts +1 on its day. Summed per key and day, with a running sum of
existence over the days of a key, the days with references and no existence are the orphans. A key has at
most one row a day after the sum, so that a key with any share of all rows stays a short window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("space", "key")


def existence_deltas(targets: DataFrame, space: str, key: Column, added: Column, deleted: Column) -> DataFrame:
    """(space, key, day, existence) of target rows with a life from `added` to before `deleted`.

    A row without a key, without a start, or whose end isn't after its start never lives. No end: it
    lives on. Repeated rows count twice at both ends, which leaves zero and positive sums as they are.
    """
    life = targets.select(F.lit(space).alias("space"), key.alias("key"), F.to_date(added).alias("from"), F.to_date(deleted).alias("to"))
    life = life.where("key is not null and `from` is not null and (`to` is null or `to` > `from`)")
    ends = F.array(F.struct(F.col("from").alias("day"), F.lit(1).alias("existence")), F.struct(F.col("to").alias("day"), F.lit(-1).alias("existence")))
    return life.select("space", "key", F.inline(ends)).where("day is not null")


def signed_counts(references: DataFrame, deltas: DataFrame) -> DataFrame:
    """(space, key, day, refs, existence): the signed sums of a day.

    references: (space, key, day); deltas: (space, key, day, existence). Both sides are summed before
    the shuffle (partial aggregation), so hot keys travel as one row a day and task.
    """
    both = references.select(*KEY, "day", F.lit(1).alias("refs"), F.lit(0).alias("existence")).unionByName(
        deltas.select(*KEY, "day", F.lit(0).alias("refs"), "existence")
    )
    return both.groupBy(*KEY, "day").agg(F.sum("refs").alias("refs"), F.sum("existence").alias("existence"))


def orphan_days(references: DataFrame, deltas: DataFrame) -> DataFrame:
    """(space, key, day, refs): days on which a key is referenced and doesn't exist. Empty inputs give no rows."""
    to_date = Window.partitionBy(*KEY).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    counts = signed_counts(references, deltas).withColumn("living", F.sum("existence").over(to_date))
    return counts.where("refs > 0 and living = 0").select(*KEY, "day", "refs")


def apply_deltas(state: DataFrame, deltas: DataFrame) -> DataFrame:
    """State (space, key, refs, existence) after a batch of deltas of the same columns, signs included; keys at zero leave it."""
    columns = (*KEY, "refs", "existence")
    merged = state.select(*columns).unionByName(deltas.select(*columns))
    merged = merged.groupBy(*KEY).agg(F.sum("refs").cast("bigint").alias("refs"), F.sum("existence").cast("bigint").alias("existence"))
    return merged.where("refs <> 0 or existence <> 0")


def current_orphans(state: DataFrame) -> DataFrame:
    """Keys with references and no existence."""
    return state.where("refs > 0 and existence <= 0").select(*KEY, "refs")


def orphan_references(references: DataFrame, deltas: DataFrame) -> DataFrame:
    """Distinct (src_table, row_key, ref_value, period) of references of which a target isn't live on their day.

    references: (src_table, row_key, ref_value, day, space, key), one row for each key that must exist;
    a reference to several keys is an orphan if one of them is missing. References without a day are none:
    nothing says when the target should live. A null key never exists.
    """
    known = references.where("day is not null").withColumn("key", F.coalesce("key", F.lit("\u0000")))
    missing = orphan_days(known, deltas)
    orphans = known.join(missing.select(*KEY, "day"), [*KEY, "day"], "left_semi")
    return orphans.select("src_table", "row_key", "ref_value", F.date_format("day", "yyyy-MM").alias("period")).distinct()
