"""Reading a landed event log by time, stream and chunk, and the catalogues of
log groups and streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import in_window


def scan_range(logs: DataFrame, start, end, order: list[str], pattern: str | None = None,
               text: str = "message", limit: int | None = None) -> DataFrame:
    """Events with start <= timestamp <= end that contain the pattern, the first
    `limit` of them in time order."""
    found = in_window(logs, start, end)
    if pattern:
        found = found.where(F.col(text).contains(pattern))
    return found.orderBy(*order).limit(limit) if limit is not None else found


def scan_stream(logs: DataFrame, stream_column: str, stream: str, start=None, end=None) -> DataFrame:
    found = logs.where(F.col(stream_column) == stream)
    if start is not None:
        found = found.where(F.col("timestamp") >= F.lit(start))
    if end is not None:
        found = found.where(F.col("timestamp") <= F.lit(end))
    return found


def time_chunks(logs: DataFrame, start: datetime, end: datetime, hours: int) -> DataFrame:
    """Events of [start, end) with the number and the bounds of their chunk. The
    last chunk ends at `end`. Chunks are half-open: no event is in two."""
    step = hours * 3600
    begin = F.lit(start).cast("timestamp")
    number = F.floor((F.unix_micros(F.col("timestamp")) - F.unix_micros(begin)) / F.lit(step * 1_000_000)).cast("bigint")
    inside = logs.where((F.col("timestamp") >= begin) & (F.col("timestamp") < F.lit(end))).withColumn("chunk", number)
    chunk_start = F.timestamp_seconds(F.unix_seconds(begin) + F.col("chunk") * step)
    chunk_end = F.timestamp_seconds(F.unix_seconds(begin) + (F.col("chunk") + 1) * step)
    return inside.withColumns(
        {"chunk_start": chunk_start, "chunk_end": F.least(chunk_end, F.lit(end).cast("timestamp"))}
    )


def log_groups(groups: DataFrame, name_prefix: str) -> DataFrame:
    """Groups by name prefix, the newest first."""
    created = F.coalesce(F.col("creation_time"), F.lit(0)).cast("bigint")
    return (
        groups.where(F.col("log_group_name").startswith(name_prefix))
        .withColumn("creation_time", created)
        .orderBy(F.desc("creation_time"), "log_group_name")
    )


def log_streams(streams: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Streams whose last event lies in the range, the latest first."""
    last = F.coalesce(F.col("last_event_ms"), F.lit(0)).cast("bigint")
    return (
        streams.withColumn("last_event_ms", last)
        .where(F.col("last_event_ms").between(start_ms, end_ms))
        .orderBy(F.desc("last_event_ms"), "stream_name")
    )


def estimate_volume(events: DataFrame, streams: DataFrame, order: list[str], text: str = "message",
                    sample: int = 1000) -> DataFrame:
    """Events estimated from the stored bytes and the average length of the
    first `sample` messages."""
    sampled = events.orderBy(*order).limit(sample).agg(
        F.count(F.lit(1)).alias("sample_size"),
        F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("bigint").alias("sample_bytes"),
    )
    stored = F.coalesce(F.sum("stored_bytes"), F.lit(0)).cast("bigint")
    average = F.try_divide(F.col("sample_bytes").cast("double"), F.col("sample_size").cast("double"))
    return sampled.select(
        "sample_size",
        F.coalesce(average, F.lit(0.0)).alias("avg_event_size"),
        F.when(F.col("sample_size") > 0, streams.agg(stored).scalar()).otherwise(F.lit(0)).alias("estimated_bytes"),
        F.when(F.col("sample_size") > 0, streams.agg(F.count(F.lit(1))).scalar()).otherwise(F.lit(0)).alias("log_streams"),
    ).withColumn(
        "estimated_events",
        F.coalesce(F.floor(F.try_divide(F.col("estimated_bytes").cast("double"), F.col("avg_event_size"))), F.lit(0)).cast("bigint"),
    )
