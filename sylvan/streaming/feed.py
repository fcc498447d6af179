"""Versions as a stream: incremental ingest and per-version results as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest_new(batch: DataFrame, store: DataFrame | None, key: str) -> DataFrame:
    """Rows of a batch whose content the store lacks, each content once: an anti join."""
    fresh = batch.dropDuplicates([key])
    return fresh if store is None else fresh.join(store.select(key), key, "left_anti")


def start_ingest(stream: DataFrame, key: str, store_path: str, checkpoint: str, work: Callable[[DataFrame], DataFrame] | None = None):
    """Streams rows into a Parquet store keyed by content; `work` (say, parsing) runs on new contents only.

    A replayed micro-batch adds nothing, as its contents are in the store already.
    """

    def sink(batch: DataFrame, _):
        spark = batch.sparkSession
        try:
            store = spark.read.parquet(store_path)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            store = None
        fresh = ingest_new(batch, store, key)
        (work(fresh) if work else fresh).write.mode("append").parquet(store_path)

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str, late: str, slide: str | None = None) -> DataFrame:
    """Counts by window and keys, with a watermark; the same plan serves batch and stream."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    return rows.groupBy(window, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(rows: DataFrame, time: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Counts by session of a key: activity without a pause of gap."""
    rows = rows.withWatermark(time, late) if rows.isStreaming else rows
    return rows.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def per_version(spark: SparkSession, versions: list, run: Callable, limit: int, budget: int = 0):
    """Yields (version, result or error) one at a time; an error halves what is left of the limit."""
    left = limit
    for v in versions:
        if left <= 0:
            return
        left -= 1
        try:
            yield v, run(spark, v)
        except ValueError as error:
            left //= 2
            yield v, error
