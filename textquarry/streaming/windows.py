"""Counts of events in windows of event time, as streams that take late rows up to a delay.

Each function makes a streaming frame from one with a timestamp ``ts``, a column to count by and a decimal to add up. A row
behind the watermark (the greatest time seen less the delay) is dropped, and a window is given out once, when the watermark
has passed its end: append mode, so the sink is an ordinary Parquet folder that restarts don't write to twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _counted(events: DataFrame, delay: str, window: Column, by: str, value: str) -> DataFrame:
    grouped = events.withWatermark("ts", delay).groupBy(window.alias("w"), F.col(by).cast("string").alias("key"))
    counts = grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return counts.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def tumbling(events: DataFrame, by: str, value: str, size: str, delay: str) -> DataFrame:
    """key, start, end, n, total of windows that follow each other."""
    return _counted(events, delay, F.window("ts", size), by, value)


def sliding(events: DataFrame, by: str, value: str, size: str, slide: str, delay: str) -> DataFrame:
    """The same for windows that overlap: a row counts in each that holds it."""
    return _counted(events, delay, F.window("ts", size, slide), by, value)


def sessions(events: DataFrame, by: str, value: str, gap: str, delay: str) -> DataFrame:
    """The same for each key's sessions, which end after a gap without rows of it."""
    return _counted(events, delay, F.session_window("ts", gap), by, value)


def start(counts: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Writes closed windows to ``path``; ``available_now`` ends when what is there has been read."""
    writer = counts.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def closed(spark: SparkSession, counts: DataFrame, path: str) -> DataFrame:
    """The windows written so far."""
    return spark.read.schema(counts.schema).parquet(path)
