"""Incremental indexing: a file stream of texts feeds the indexes, batch by batch."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textquarry.plans import store
from textquarry.sources.corpus import strict_utf8

log = logging.getLogger(__name__)


def stream_texts(spark: SparkSession, directory: str, strict: bool = True) -> DataFrame:
    """New text files of a folder, one row a line (only line feeds end lines). ``strict`` fails on bytes that are not UTF-8."""
    raw = spark.readStream.option("lineSep", "\n").text(directory).select(F.col("value").alias("text"))
    return (strict_utf8(raw) if strict else raw).select(F.regexp_replace("text", "\r$", "").alias("text"))


def start_indexing(
    texts: DataFrame, root: str, checkpoint: str, available_now: bool = True, any_script: bool = False, compact_every: int = 0
) -> StreamingQuery:
    """Appends each micro-batch to the index at ``root``. A repeated batch is known by its number, so restarts add nothing twice.

    ``compact_every``: batches after which the segments are merged into one. Tokenising is stateless, so no watermark is needed.
    """
    source = f"stream:{checkpoint}"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        store.append(batch, root, store.Items(any_script), source, number)
        if compact_every and sum(not s.retracts for s in store.version(spark, root).segments) > compact_every:
            try:
                store.compact(spark, root, layout=store.Items(any_script))
            except store.ConcurrentCommit:
                log.info("compaction of %s left to a later batch", root)

    writer = texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def load_stream_index(spark: SparkSession, root: str) -> dict:
    """The indexes over all batches so far; before the first they are empty."""
    return store.load(spark, root)
