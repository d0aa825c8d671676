import os

from marginalia.session import forget_written, written


def test_written_tables_are_removed(spark):
    df = written(spark.range(5).toDF("n"))
    folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert df.count() == 5 and os.path.isdir(folder)
    forget_written(spark)
    assert not os.path.exists(folder)


def test_written_tables_are_not_sent_through_the_driver(spark):
    small, most = written(spark.range(9)), spark.conf.get("spark.sql.maxBroadcastTableSize")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1")
    try:
        assert small.selectExpr("explode(sequence(id, 9)) as id").join(spark.range(9), "id").count() == sum(9 - i for i in range(9))
    finally:
        spark.conf.set("spark.sql.maxBroadcastTableSize", most)
