import random
import re

from pyspark.sql import functions as F

from marginalia.operators import copies


def test_pairs_equal_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    rows = [("none", None), ("empty", ""), ("x", "same " * 60), ("y", "Same! " * 70)]
    for base in range(8):
        body = [rng.choice(words) for _ in range(rng.choice([60, 200]))]
        for k in range(4):
            other = list(body)
            for _ in range(rng.randint(0, 4)):
                other[rng.randrange(len(other))] = rng.choice(words)
            rows.append((f"{base}-{k}", " ".join(other)))
    docs = spark.createDataFrame(rows, "id string, body string").withColumn("runs", F.lit("clash"))
    sets = {}
    for i, t in rows:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        if len(w) >= 50:
            sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    pairs = copies.similar_pairs(copies.documents(docs, "id", "body"))
    assert {(r.a, r.b) for r in pairs.collect()} == want and len(want) > 5
    assert copies.similar_pairs(copies.documents(docs.limit(0), "id", "body")).count() == 0


def test_hot_runs_are_split(spark, monkeypatch):
    from marginalia.operators import skew

    rows = [(f"{i:02}", "the very same passage " * 20 + (f"w{i} " * 5)) for i in range(30)]
    docs = copies.documents(spark.createDataFrame(rows, "id string, body string"), "id", "body")
    plain = {tuple(r) for r in copies.similar_pairs(docs, 0.1).collect()}
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (5,))
    assert {tuple(r) for r in copies.similar_pairs(docs, 0.1).collect()} == plain and len(plain) == 435


def test_only_in_keeps_order_and_repeats(spark):
    df = spark.createDataFrame([(["B!", "a", "B!", "c"], ["A."])], "x array<string>, y array<string>")
    assert df.select(copies.only_in(F.col("x"), F.col("y")).alias("o")).first().o == ["B!", "B!", "c"]


def test_siblings(spark):
    pairs = spark.createDataFrame([("f", "g"), ("g", "h"), ("f", "f")], "a string, b string")
    findings = spark.createDataFrame([("p", "f", False), ("p", "g", False), ("q", "g", False), ("q", "h", True)], "problem string, file string, accepted boolean")
    got = sorted(tuple(r) for r in copies.sibling_findings(findings, copies.sibling_files(pairs)).collect())
    assert got == [("p", "shared-finding", "f", "g"), ("p", "uneven-copy", "g", "h"), ("q", "half-accepted-copy", "h", "g"), ("q", "uneven-copy", "g", "f"), ("q", "uneven-copy", "g", "h")]


def test_runs_are_not_sent_through_the_driver(spark, tmp_path):
    # A small file of many runs: by its size the planner would send all of them to all executors.
    rows = [(f"{i:03}", " ".join(f"w{i % 40} x{i % 40 * j}" for j in range(60))) for i in range(80)]
    spark.createDataFrame(rows, "id string, body string").write.parquet(str(tmp_path / "texts"))
    docs = copies.documents(spark.read.parquet(str(tmp_path / "texts")), "id", "body")
    most = spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1")
    try:
        got = {(r.a, r.b, r.score) for r in copies.similar_pairs(docs).collect()}
    finally:
        spark.conf.set("spark.sql.maxBroadcastTableSize", most)
    assert got == {(f"{i:03}", f"{i + 40:03}", 1.0) for i in range(40)}


def test_sentences_and_words_are_not_sent_through_the_driver(spark, tmp_path):
    from marginalia.plans import copies as plans

    text = " ".join(f"One sentence of some words stands here in row w{i}." for i in range(12)) + " "
    rows = [("a", text, "f:1:1"), ("b", text + "Another sentence is added.", "g:1:1"), ("c", "too short", "h:1:1")]
    spark.createDataFrame(rows, "text_id string, text string, editor_ref string").write.parquet(str(tmp_path / "text_docs.parquet"))
    pairs = spark.createDataFrame([("a", "b", 0.9)], "a string, b string, score double")
    docs = plans._docs(spark, str(tmp_path))
    most = spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1")
    try:
        drift = copies.drift(pairs.repartition(2), docs, "text_id", "text").first()
        with_words = plans.pair_identity(spark, str(tmp_path)).count()
    finally:
        spark.conf.set("spark.sql.maxBroadcastTableSize", most)
    assert (drift.only_a, drift.only_b, drift.drifted, with_words) == ([], ["Another sentence is added."], True, 1)
