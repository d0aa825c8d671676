import datetime as d
import random

from pyspark.sql import functions as F

from marginalia.operators.references import apply_deltas, current_orphans, existence_deltas, orphan_references
from marginalia.streaming.changes import OrphanLedger

DAY = d.date(2025, 1, 1)


def day(n):
    return DAY + d.timedelta(n)


def test_equals_brute_force(spark):
    rng = random.Random(6)
    lives = [(rng.choice("abcdef"), day(rng.randint(0, 9)) if rng.random() > 0.1 else None, day(rng.randint(0, 12)) if rng.random() > 0.4 else None) for _ in range(40)] + [(None, DAY, None)]
    lives += lives[:5]
    refs = [("t", str(i), "v", day(rng.randint(0, 12)) if rng.random() > 0.1 else None, "s", rng.choice("abcdefgh") if rng.random() > 0.05 else None) for i in range(200)]
    targets = spark.createDataFrame(lives, "key string, a date, b date").withColumn("existence", F.lit("clash"))
    deltas = existence_deltas(targets, "s", F.col("key"), F.col("a"), F.col("b"))
    got = {r.row_key for r in orphan_references(spark.createDataFrame(refs, "src_table string, row_key string, ref_value string, day date, space string, key string"), deltas).collect()}
    want = {r[1] for r in refs if r[3] and not any(k == r[5] and k is not None and a and a <= r[3] and not (b and b <= r[3]) for k, a, b in lives)}
    assert got == want


def test_pair_needs_both(spark):
    deltas = existence_deltas(spark.createDataFrame([("a", DAY, None)], "key string, a date, b date"), "s", F.col("key"), F.col("a"), F.col("b"))
    refs = [("t", "1", "a :: b", day(1), "s", "a"), ("t", "1", "a :: b", day(1), "s", "b"), ("t", "2", "a", day(1), "s", "a"), ("t", "3", "a", day(-1), "s", "a")]
    rows = orphan_references(spark.createDataFrame(refs, "src_table string, row_key string, ref_value string, day date, space string, key string"), deltas).collect()
    assert sorted((r.row_key, r.period) for r in rows) == [("1", "2025-01"), ("3", "2024-12")]


def test_empty(spark):
    refs = spark.createDataFrame([], "src_table string, row_key string, ref_value string, day date, space string, key string")
    deltas = spark.createDataFrame([], "space string, key string, day date, existence int")
    assert orphan_references(refs, deltas).count() == 0


def test_state_after_batches(spark, tmp_path):
    schema = "space string, key string, refs int, existence int"
    batches = [[("s", "a", 1, 0), ("s", "b", 1, 1)], [("s", "a", 0, 1), ("s", "b", 0, -1), ("s", "c", 2, 0)], [("s", "c", -2, 0)]]
    book = OrphanLedger(spark, str(tmp_path))
    seen = []
    for n, rows in enumerate(batches):
        book.add(spark.createDataFrame(rows, schema), n)
        book.add(spark.createDataFrame(rows, schema), n)  # delivered again
        seen.append({(r.key, r.refs) for r in book.orphans(n).collect()})
    assert seen == [{("a", 1)}, {("b", 1), ("c", 2)}, {("b", 1)}]
    state = book.version(2)
    assert current_orphans(apply_deltas(state, spark.createDataFrame([("s", "b", -1, 0)], schema))).count() == 0
