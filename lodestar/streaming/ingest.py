"""Incremental ingest and event-time histograms by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest_objects(stream: DataFrame, table: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Append new objects, features extracted, to the Parquet table of objects."""
    return extract(stream).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def score_stream(queries: DataFrame, retrieve: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of query objects runs as one retrieval against the static objects; its result is a folder named by the batch, so a repeated batch replaces itself."""

    def run(batch: DataFrame, number: int) -> None:
        retrieve(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _timed(events: DataFrame) -> DataFrame:
    """Watermarks need timestamps with a time zone; those without are read in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def event_histograms(events: DataFrame, keys: Sequence[str] = ("event_type",), every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and value sums by event-time window; events later than the watermark are dropped."""
    return _timed(events).withWatermark("ts", late).groupBy(F.window("ts", every), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, key: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sparse activity histograms by session: events of a user with gaps below ``gap``."""
    return _timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
