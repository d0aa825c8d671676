from marginalia.streaming.changes import EMPTY, OrphanLedger, drained, event_counts


def test_ledger_follows_a_stream(spark, tmp_path):
    schema = "space string, key string, refs int, existence int"
    inbox, book = str(tmp_path / "in"), OrphanLedger(spark, str(tmp_path / "state"))
    spark.createDataFrame([("s", "a", 1, 0), ("s", "b", 2, 1)], schema).write.parquet(inbox)
    stream = spark.readStream.schema(schema).parquet(inbox)
    for extra in (None, [("s", "a", 0, 1), ("s", "b", 0, -1)]):
        if extra:
            spark.createDataFrame(extra, schema).coalesce(1).write.mode("append").parquet(inbox)
        query = book.follow(stream, str(tmp_path / "mark"))
        query.processAllAvailable()
        query.stop()
    assert [(r.key, r.refs) for r in book.orphans(1).collect()] == [("b", 2)]


def test_event_windows(spark, tmp_path):
    rows = [("2025-01-01 10:05:00", "x", 1.0), ("2025-01-01 10:55:00", "x", 2.0), ("2025-01-01 11:00:00", "y", None)]
    path = str(tmp_path / "events")
    spark.createDataFrame(rows, "t string, kind string, value double").selectExpr("cast(t as timestamp) as ts", "kind", "value").write.parquet(path)
    stream = spark.readStream.schema("ts timestamp, kind string, value double").parquet(path)
    got = sorted((str(r.start), r.kind, r.n, r.total) for r in drained(event_counts(stream, "ts", "kind")).collect())
    assert got == [("2025-01-01 10:00:00", "x", 2, 3.0), ("2025-01-01 11:00:00", "y", 1, None)]


def test_ledger_keeps_two_versions(spark, tmp_path):
    book = OrphanLedger(spark, str(tmp_path))
    for number, rows in enumerate([[("s", "a", 1, 0), ("s", "b", 1, 0)], [("s", "a", 0, 1)], [("s", "b", -1, 0)], [("s", "a", 0, -1)]]):
        book.add(spark.createDataFrame(rows, EMPTY), number)
        book.add(spark.createDataFrame(rows, EMPTY), number)
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["version=2", "version=3"]
    assert [(r.key, r.refs) for r in book.orphans(3).collect()] == [("a", 1)]
