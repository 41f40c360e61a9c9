"""Windows over event streams; the same functions work on tables.

These go beyond tables of a workbook: the formula language has no streams.
Late events are dropped beyond the watermark, which bounds the state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """A folder of Parquet files as a stream, some files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _timed(events: DataFrame, time: str, late: str | None) -> DataFrame:
    """Watermarks need instants; times without a zone are read in the session's."""
    if late is None:
        return events
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def tumbling(events: DataFrame, time: str, size: str, keys: list[str], measures: dict[str, Column], late: str | None = None) -> DataFrame:
    """Measures for each key and window: keys, window_start, window_end, measures."""
    events = _timed(events, time, late)
    out = events.groupBy(F.window(time, size).alias("w"), *keys).agg(*[m.alias(n) for n, m in measures.items()])
    return out.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *measures)


def sliding(events: DataFrame, time: str, size: str, slide: str, keys: list[str], measures: dict[str, Column], late: str | None = None) -> DataFrame:
    """As ``tumbling``, with windows that overlap: each event is in size / slide of them."""
    events = _timed(events, time, late)
    out = events.groupBy(F.window(time, size, slide).alias("w"), *keys).agg(*[m.alias(n) for n, m in measures.items()])
    return out.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *measures)


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], measures: dict[str, Column], late: str | None = None) -> DataFrame:
    """Sessions of each key, which end after ``gap`` without an event."""
    events = _timed(events, time, late)
    out = events.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*[m.alias(n) for n, m in measures.items()])
    return out.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *measures)


def run_to_table(view: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Runs a streaming view over what is there and stops; its state is in ``checkpoint`` and its result the view ``name``.

    Each batch writes what it found as Parquet beside the checkpoint, from the
    tasks: all windows in complete mode, of which the last batch's are the
    result, else those that changed or closed.  A batch that is run again
    replaces its own files.
    """
    spark, folder = view.sparkSession, f"{checkpoint}-result"

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(folder if mode == "complete" else f"{folder}/batch={n}")
        spark.read.schema(view.schema).parquet(folder).select(*view.columns).createOrReplaceTempView(name)

    keep(spark.createDataFrame([], view.schema), -1)
    return view.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_view(view: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends closed windows to Parquet; exactly once, also over restarts."""
    return view.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).start()
