import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marginalia.llm import shared_spans as s

SPAN, MER = 40, 9


def corpus():
    rng = random.Random(2)
    letter = lambda n: "".join(rng.choice("abcd é🙂日\n") for _ in range(n))
    passages = [letter(n) for n in (39, 40, 41, 90, 300)]
    rows = [("t", 1, None), ("t", 2, ""), ("t", 3, "x" * 200), ("t", 4, "x" * 41), ("u", 5, "x" * 90), ("t", None, "x" * 90)]
    for no in range(10, 70):
        text = letter(rng.randint(0, 120))
        for p in rng.sample(passages, rng.randint(0, 3)):
            text += p + letter(rng.randint(0, 60))
        rows.append((rng.choice("tu"), no, text))
    self_repeat = letter(80)
    rows.append(("t", 100, self_repeat + "|" + self_repeat))
    return [*rows, rows[10], rows[-1], rows[-1]]


def brute(rows):
    where = defaultdict(set)
    for src, no, text in rows:
        for i in range(len(text or "") - SPAN + 1):
            where[src, text[i : i + SPAN]].add(no)
    out = defaultdict(set)
    for src, no, text in rows:
        for i in range(len(text or "") - SPAN + 1):
            if no is not None and len(where[src, text[i : i + SPAN]] - {None}) > 1:
                out[src, no] |= set(range(i, i + SPAN))
    return out


@pytest.mark.parametrize("hot", [10**9, 3, 0])
def test_coverage_equals_brute_force(spark, hot):
    rows = corpus()
    records = spark.createDataFrame(rows, "src string, no long, text string").withColumn("packed", F.lit("clash")).withColumn("mini", F.lit(1))
    want = brute(rows)
    got = {(r.src, r.no): r for r in s.coverage(records, span=SPAN, mer=MER, hot=hot).collect()}
    assert {k: r.shared_chars for k, r in got.items() if r.shared_chars} == {k: len(v) for k, v in want.items()}
    assert set(got) == {(a, b) for a, b, _ in rows if b is not None}
    assert {tuple(r) for r in s.found(records, span=SPAN, mer=MER, hot=hot).collect()} == set(want)


def test_empty(spark):
    assert s.coverage(spark.createDataFrame([], "src string, no long, text string")).count() == 0
