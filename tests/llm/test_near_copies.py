import random
import re

from pyspark.sql import functions as F

from marginalia.llm import near_copies as n


def brute(rows):
    sets = {}
    for no, text in rows:
        w = re.findall("[a-z0-9]+", (text or "").lower())
        if no is not None and len(w) >= 50:
            sets[no] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    return {(a, b) for a in sets for b in sets if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    standing = " ".join(rng.choice(words) for _ in range(30))
    rows = [(None, "x " * 60), (900, None), (901, ""), (902, "too short"), (903, "Same " * 80), (904, "same! " * 75)]
    for base in range(12):
        text = [rng.choice(words) for _ in range(rng.choice([49, 50, 55, 120, 800]))]
        for k in range(6):
            other = list(text)
            for _ in range(rng.randint(0, 1 + len(text) // 40)):
                other[rng.randrange(len(other))] = rng.choice(words)
            rows.append((base * 10 + k, (" ".join(other) + (" É. " if k % 2 else " ") + standing)))
    return rows + rows[7:9]


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "id long, text string").withColumn("runs", F.lit(1)).withColumn("no", F.lit("clash"))
    got = {tuple(r) for r in n.found(docs, "id", "text").collect()}
    assert got == brute(rows) and len(got) > 20


def test_groups(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "id long, text string")
    pairs = brute(rows)
    got = {r.no: (r.group_no, r.links) for r in n.groups(docs, "id", "text").collect()}
    root = {x: x for x in got}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert got == {x: (find(x), sum(x in p for p in pairs)) for x in got}


def test_hot_cells_and_copies_are_split(spark, monkeypatch):
    from marginalia.operators import skew

    rows = corpus() + [(2000 + i, "the very same words " * 20 + "tail " * 3) for i in range(12)]
    docs = spark.createDataFrame(rows, "id long, text string")
    want = {tuple(r) for r in n.groups(docs, "id", "text").collect()}
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (3,))
    assert {tuple(r) for r in n.found(docs, "id", "text").collect()} == brute(rows)
    assert {tuple(r) for r in n.groups(docs, "id", "text").collect()} == want


def test_empty(spark):
    docs = spark.createDataFrame([], "id long, text string")
    assert n.found(docs, "id", "text").count() == 0
    assert n.groups(docs, "id", "text").count() == 0


def test_chain_components(spark):
    rng = random.Random(3)
    names = rng.sample(range(10_000), 3000)
    edges = spark.createDataFrame(list(zip(names, names[1:], strict=False)) + [(20_000, 20_001)], "a long, b long")
    got = {r.no: r.root for r in n.components(edges).collect()}
    assert set(got.values()) <= {min(names), 20_000} and len(got) >= 3000


def test_long_texts_are_bounded_below(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**9)}" for _ in range(40_000)]
    other = list(words)
    for _ in range(900):
        other[rng.randrange(len(other))] = "x"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(reversed(words)))], "id long, text string")
    rows = n.fingerprints(docs, "id", "text").collect()
    vectors = [r.bound for r in sorted(rows, key=lambda r: r.no)]
    runs = [set(r.runs) for r in sorted(rows, key=lambda r: r.no)]
    import pyarrow as pa

    for i, j in ((0, 1), (0, 2)):
        low = n.distance(pa.array([vectors[i]], pa.binary()), pa.array([vectors[j]], pa.binary()))[0].as_py()
        assert 0 < low <= len(runs[i] ^ runs[j])
    assert [tuple(r) for r in n.found(docs, "id", "text").collect()] == [(1, 2)]
