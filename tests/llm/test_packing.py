import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from marginalia.llm.packing import pack, plan


def used(recipes):
    out = Counter()
    for sizes, times in recipes:
        for s in sizes:
            out[s] += times
    return out


@pytest.mark.parametrize("capacity", [1, 2, 7, 100, 512])
def test_plan_uses_all_and_fits(capacity):
    rng = random.Random(capacity)
    for spread in (3, 40, 400):
        items = Counter(rng.randint(1, capacity) for _ in range(spread * 5))
        recipes = plan(items, capacity)
        assert used(recipes) == items
        assert all(sum(s) <= capacity for s, _ in recipes)
        assert sum(t for _, t in recipes) <= 1.23 * sum(s * n for s, n in items.items()) / capacity + 1 + sum(n for s, n in items.items() if 2 * s > capacity)


def test_exact_fillings():
    assert sum(t for _, t in plan({60: 5, 40: 5}, 100)) == 5
    assert sum(t for _, t in plan({50: 4, 30: 4, 20: 4}, 100)) == 4
    assert sum(t for _, t in plan({41: 3, 31: 3, 17: 3, 11: 3}, 100)) == 3
    assert plan({}, 10) == []


def test_large_histogram():
    rng = random.Random(1)
    items = Counter(min(8192, int(rng.lognormvariate(5.5, 1))) + 1 for _ in range(200_000))
    items = Counter({min(s, 8192): n for s, n in items.items()})
    recipes = plan(items, 8192)
    assert used(recipes) == items
    assert sum(t for _, t in recipes) * 8192 <= 1.002 * sum(s * n for s, n in items.items()) + 8192


def test_rows(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 1, 7, 33, 50, 99, 100, 101, 250, 1000])) for i in range(600)] + [(700, None), (None, 5), (3, 20), (3, 20)]
    docs = spark.createDataFrame(rows, "doc_id long, n int").withColumn("tokens", F.lit("clash")).withColumn("capacity", F.lit(1))
    out = pack(docs, "doc_id", "n", {"a": 100, "b": 64}).collect()
    for name, capacity in (("a", 100), ("b", 64)):
        mine = [r for r in out if r.window_name == name]
        load, spans = Counter(), defaultdict(list)
        for r in mine:
            load[r.container_no] += r.tokens
            spans[r.doc_id].append((r.start_token, r.tokens))
        assert max(load.values()) <= capacity and set(load) == set(range(len(load)))
        want = Counter(n or 0 for _, n in rows)
        assert sum(want.elements()) == sum(load.values())
        for i, n in rows[:600]:
            if i != 3:
                at = 0
                for start, tokens in sorted(spans[i]):
                    assert start == at
                    at += tokens
                assert at == n and len(spans[i]) == max(1, -(-n // capacity))
    assert pack(docs.limit(0), "doc_id", "n", {"a": 100}).count() == 0
    assert {r.container_no for r in pack(docs.where("n = 0"), "doc_id", "n", {"a": 9}).collect()} == {0}


def test_large_capacity_is_planned_in_time():
    import time

    rng = random.Random(6)
    sizes = [min(32_768, int(rng.lognormvariate(6.5, 1.3)) + 1) for _ in range(300_000)]
    began = time.perf_counter()
    containers = sum(n for _, n in plan(Counter(sizes), 32_768))
    assert time.perf_counter() - began < 60
    assert containers <= 1.001 * -(-sum(sizes) // 32_768) + 1
