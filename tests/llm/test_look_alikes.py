import random
import unicodedata

from pyspark.sql import functions as F

from marginalia.llm.look_alikes import TABLE, found, groups, unify, uniform

SAME = [
    ("café", "café", "cаf​е́", "ｃａｆé", "c\xadafé⁠"),
    ("office ﬂow", "oﬀice flow", "oﬃce\xa0ﬂow", "office　flow", "office flow"),
    ("Ρort АВС", "Port ABC", "Ｐort ABC"),
    ("a\r\nb", "a\nb", "a\rb"),
    ("ё", "ë", "ё"),
    ("ộ", "ộ", "ộ"),
]
DIFFERENT = [("café", "cafè"), ("Port", "port"), ("“a”", '"a"'), ("a–b", "a-b"), ("👩‍💻", "👩💻"), ("rn", "m"), ("ж", "k"), ("x²", "x2"), ("i", "ı"), ("…", "...")]


def test_same():
    for texts in SAME:
        assert len({uniform(t) for t in texts}) == 1, [uniform(t) for t in texts]


def test_different():
    for a, b in DIFFERENT:
        assert uniform(a) != uniform(b)


def test_settled():
    rng = random.Random(1)
    some = [*TABLE, *"각가ﾡￂｶﾞﾟ\u09c7\u09be\u0cc6\u0cd5", "a", "́", "̈", "‍", "👩", "\r", "\n", " ", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(some) for _ in range(rng.randint(0, 12)))
        once = uniform(text)
        assert uniform(once) == once, ascii(text)
    assert all(uniform(c) == unicodedata.normalize("NFC", t) for c, t in TABLE.items())
    assert uniform(None) is None and uniform("") == "" and len(uniform("е" * 100_000 + "́" * 50_000)) > 100_000


def test_pairs(spark):
    rows = [("t", 1, "one two"), ("t", 2, "one\xa0two"), ("t", 3, "one  two "), ("t", 4, "оne two"), ("u", 5, "оne two"), ("t", 6, None), ("t", None, "one\xa0two"), ("t", 2, "one\xa0two"), ("t", 7, "one\xa0two"), ("t", 8, ""), ("t", 9, "​"), ("t", 10, "One two")]
    records = spark.createDataFrame(rows, "src string, no long, text string").withColumn("form", F.lit("clash")).withColumn("plain", F.lit(1))
    got = {tuple(r) for r in found(records).collect()}
    # 3 has another visible space between the words; 2 and 7 are exact copies.
    assert got == {("t", 1, 2), ("t", 1, 4), ("t", 1, 7), ("t", 2, 4), ("t", 4, 7), ("t", 8, 9)}
    assert found(records.limit(0)).count() == 0
    assert [r[0] for r in records.select(unify(F.col("text"))).limit(2).collect()] == ["one two", "one two"]


def test_groups_and_hot_forms(spark, monkeypatch):
    from marginalia.operators import skew

    rows = [("t", i, "one two") for i in range(20)] + [("t", 20 + i, "one" + "\u200b" * (i + 1) + " two") for i in range(20)] + [("t", 90, "other"), ("u", 91, "one two"), ("t", 92, None), ("t", 90, "оther"), ("t", 95, "оther")]
    records = spark.createDataFrame(rows, "src string, no long, text string").withColumn("first", F.lit("clash"))
    pairs, table = {tuple(r) for r in found(records).collect()}, {tuple(r) for r in groups(records).collect()}
    assert ("t", 0, 0, 20) in table and ("t", 25, 0, 39) in table and ("u", 91, 91, 0) in table and len(table) == 43
    assert len(pairs) == 20 * 20 + 190 + 1
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (5,))
    assert {tuple(r) for r in found(records).collect()} == pairs and {tuple(r) for r in groups(records).collect()} == table
    assert groups(records.limit(0)).count() == 0
