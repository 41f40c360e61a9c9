"""Streams give what tables give."""

from datetime import datetime

from pyspark.sql import functions as F

from lattiq.streaming import events as ev

ROWS = [(datetime(2024, 1, 1, 0, m), "a" if m % 2 else "b", float(m)) for m in range(0, 60, 7)]


def test_stream_equals_table(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "ts timestamp, k string, v double")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    measures = {"n": F.count(F.lit(1)), "s": F.sum("v")}
    stream = ev.tumbling(ev.read_events(spark, str(tmp_path / "in"), df.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), 1), "ts", "10 minutes", ["k"], measures, "1 hour")
    ev.run_to_table(stream, "tumbling_test", str(tmp_path / "state")).awaitTermination()
    want = ev.tumbling(df, "ts", "10 minutes", ["k"], measures)
    assert sorted(map(tuple, spark.table("tumbling_test").collect())) == sorted(map(tuple, want.collect()))


def test_sessions_and_sliding(spark):
    df = spark.createDataFrame(ROWS, "ts timestamp, k string, v double")
    assert ev.sessions(df, "ts", "8 minutes", [], {"n": F.count(F.lit(1))}).count() == 1
    assert ev.sessions(df, "ts", "5 minutes", [], {"n": F.count(F.lit(1))}).count() == len(ROWS)
    assert ev.sliding(df, "ts", "20 minutes", "10 minutes", [], {"n": F.count(F.lit(1))}).agg(F.sum("n")).first()[0] == 2 * len(ROWS)
