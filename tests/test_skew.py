from marginalia.operators.skew import hot_keys, split_join


def test_split_join_equals_join(spark):
    left = spark.createDataFrame([("h", i) for i in range(200)] + [("x", 1), ("y", 2), (None, 3)], "k string, no long")
    right = spark.createDataFrame([("h", "a"), ("h", "b"), ("y", "c"), ("z", "d"), (None, "e")], "k string, v string")
    sizes = left.groupBy("k").count()
    hot = hot_keys(sizes, ["k"], "count", hot=100)
    assert [r.k for r in hot.collect()] == ["h"]
    assert hot_keys(sizes, ["k"], "count") is None and hot_keys(sizes.limit(0), ["k"], "count", hot=1) is None
    got = split_join(left, right, ["k"], "no", hot, parts=7)
    assert got.columns == ["k", "no", "v"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").collect())) == sorted([("h", i, v) for i in range(200) for v in "ab"] + [("y", 2, "c")])
    assert split_join(left, right, ["k"], "no", None).count() == 401
