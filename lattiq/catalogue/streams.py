"""Windows over the events, as tables and as a stream."""

import uuid

from pyspark.sql import functions as F

from lattiq.catalogue.base import register, table
from lattiq.checkpoints import ensure_folder
from lattiq.streaming import events as ev

_DAY = "SELECT event_type, CAST(date_trunc('day', ts) AS VARCHAR) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def _measures():
    return {"n": F.count(F.lit(1)), "total": F.round(F.sum("value"), 4)}


@register("stream_tumbling_batch", _DAY)
def _tumbling(spark, sf_dir):
    return ev.tumbling(table(spark, sf_dir, "events"), "ts", "1 day", ["event_type"], _measures()).select("event_type", F.col("window_start").cast("string").alias("day"), "n", "total")


@register("stream_sliding_batch", "SELECT CAST(date_trunc('day', ts) - INTERVAL (i) DAY AS VARCHAR) AS day, count(*) AS n FROM events, (VALUES (0), (1)) AS t(i) GROUP BY 1")
def _sliding(spark, sf_dir):
    return ev.sliding(table(spark, sf_dir, "events"), "ts", "2 days", "1 day", [], {"n": F.count(F.lit(1))}).select(F.col("window_start").cast("string").alias("day"), "n")


@register(
    "stream_sessions_batch",
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, count(*) AS n FROM s GROUP BY user_id, k",
)
def _sessions(spark, sf_dir):
    out = ev.sessions(table(spark, sf_dir, "events"), "ts", "6 hours", ["user_id"], {"n": F.count(F.lit(1))})
    return out.select("user_id", F.unix_micros(F.col("session_start").cast("timestamp")).alias("start_us"), "n")


@register("stream_tumbling", _DAY)
def _stream(spark, sf_dir):
    ensure_folder(spark)
    rows = table(spark, sf_dir, "events")
    folder = spark.sparkContext.getCheckpointDir()
    name = f"events_{uuid.uuid4().hex}"
    # The stream reads the events' Parquet file as it stands.
    stream = spark.readStream.schema(rows.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    view = ev.tumbling(stream, "ts", "1 day", ["event_type"], _measures(), late="1 day")
    ev.run_to_table(view, name, f"{folder}/{name}").awaitTermination()
    return spark.table(name).select("event_type", F.col("window_start").cast("string").alias("day"), "n", "total")
