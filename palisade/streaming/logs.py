"""Landed files as a stream: bounded batches, the same decoding as in batch jobs."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.numbers import pct2
from ..operators import append, metrics, store
from ..session import scratch_path
from ..sources import raw


def stream_lines(spark: SparkSession, path: str, files_per_batch: int | None = None, glob: str = "*") -> DataFrame:
    """Rows (value, path) of every line as it lands, cut as batch jobs cut them."""
    reader = spark.readStream.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.text(path)
    cut = lines.select(F.explode(raw.value_pieces(F.col("value"))).alias("value"), F.col("_metadata.file_path").alias("path"))
    return cut.where(F.trim("value") != "")


def stream_logs(spark: SparkSession, path: str, normalize, files_per_batch: int | None = None, glob: str = "*") -> DataFrame:
    """Decoded and normalised rows of every file as it lands."""
    return normalize(raw.decode_any(stream_lines(spark, path, files_per_batch, glob)))


def land_logs(lines: DataFrame, path: str, checkpoint: str, normalize, order: list[str] | None = None) -> StreamingQuery:
    """Every record of a stream of lines, in three folders: `rows` as `normalize` makes them
    of decoded records, `rejects` with the text, file and status of what could not be read,
    and `counters` per file, as `parse_summary` counts them. Each has a folder for each
    batch, so a batch that is run again replaces its own. With an order, rows get
    consecutive ids over all batches (see `append_numbered`). A batch is decoded once and
    kept on the executors, on disk where memory is short, while the three are written."""
    ids = numbered_writer(lines.sparkSession, f"{path}/rows", order) if order else None

    def one(batch: DataFrame, number: int) -> None:
        decoded = raw.decode_any(batch).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            rows = normalize(decoded)
            if ids:
                ids(rows, number)
            else:
                rows.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
            rejected = raw.reject_rows(decoded).select("path", "value", "decode_status")
            rejected.write.mode("overwrite").parquet(f"{path}/rejects/batch={number}")
            raw.parse_summary(decoded, "path").write.mode("overwrite").parquet(f"{path}/counters/batch={number}")
        finally:
            decoded.unpersist()

    return lines.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def landed_counters(spark: SparkSession, path: str) -> DataFrame:
    """Counters of all batches of `land_logs`, by file. A file is read in one batch."""
    names = ["found", "processed", "valid", "invalid", "skipped"]
    return spark.read.parquet(f"{path}/counters").groupBy("path").agg(*[F.sum(n).alias(n) for n in names])


def write_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything landed so far to a Parquet folder, then stop."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return query.outputMode("append").trigger(availableNow=True).start()


def numbered_writer(spark: SparkSession, path: str, order: list[str]):
    """Writes batch after batch with consecutive ids. Every batch writes a folder named by
    its number, and beside it the id that comes next, which is all that the following
    batch reads: a batch costs as much as its rows, however long the table. A batch that
    is run again after a failure replaces both and gets the same ids."""

    def write(batch: DataFrame, number: int) -> None:
        first = spark.read.schema("next_id bigint").json(f"{path}/_next/{number - 1}").first()[0] if number else 0
        numbered = append.append_logs(None, batch, order).withColumn("log_id", F.col("log_id") + first)
        numbered.write.mode("overwrite").parquet(f"{path}/batch={number}")
        rows = spark.read.schema("log_id bigint").parquet(f"{path}/batch={number}").count()
        spark.range(1).select(F.lit(first + rows).cast("bigint").alias("next_id")).write.mode("overwrite").json(f"{path}/_next/{number}")

    return write


def append_numbered(df: DataFrame, path: str, checkpoint: str, order: list[str]) -> StreamingQuery:
    """Append normalised rows batch by batch with consecutive ids."""
    writer = df.writeStream.foreachBatch(numbered_writer(df.sparkSession, path, order))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(logs: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Requests per hour with a watermark; state is one row per open hour."""
    hours = logs.withWatermark("timestamp", delay).groupBy(F.window("timestamp", "1 hour"))
    counts = hours.agg(metrics.n_rows().alias("total_requests"), metrics.acted("BLOCK").alias("blocked"), metrics.acted("ALLOW").alias("allowed"))
    return counts.select(
        F.col("window.start").alias("hour"), "total_requests", "blocked", "allowed", pct2("blocked", "total_requests").alias("block_rate_percent")
    )


def daily_counts(logs: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Daily trends with exact distinct clients, by two stateful steps under one watermark:
    the first holds a row of counts for each client of an open day, which is the first sight
    of the client on that day; when the day closes they go to the second, which adds them
    up. State is the clients of open days, spread over all tasks by day and client."""
    clients = logs.withWatermark("timestamp", delay).groupBy(F.window("timestamp", "1 day"), "client_ip").agg(
        metrics.n_rows().alias("n"), metrics.acted("BLOCK").alias("blocked"), metrics.acted("ALLOW").alias("allowed")
    )
    days = clients.groupBy(F.window(F.window_time("window"), "1 day").alias("day")).agg(
        F.sum("n").alias("total_requests"), F.sum("blocked").alias("blocked"), F.sum("allowed").alias("allowed"), F.count("client_ip").alias("unique_ips")
    )
    return days.select(
        F.to_date("day.start").alias("date"), "total_requests", "blocked", "allowed", "unique_ips", pct2("blocked", "total_requests").alias("block_rate_percent")
    )


def upsert_stream(df: DataFrame, path: str, checkpoint: str, key: str, order: list[str], keep_first: list[str] | None = None, buckets: int = 64) -> StreamingQuery:
    """Maintain a keyed table (see `operators/store.py`) from repeated dumps. A batch
    rewrites the buckets it touches, as the version that bears its number, on top of the
    version before it, so a repeated batch gives the same. `order` may name batch_number."""

    def one(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("batch_number", F.lit(number).cast("bigint"))
        store.merge(rows, path, key, order, keep_first, version=number, buckets=buckets)

    return df.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(start, spark: SparkSession, label: str) -> str:
    """Run a stream over what has landed and return the folder it wrote."""
    path, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-state")
    start(path, checkpoint).awaitTermination()
    return path


def late_rows(progress: list[dict]) -> int:
    """Rows a stream dropped as later than its watermark, from its progress reports."""
    return sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in progress for s in p.get("stateOperators", []))
