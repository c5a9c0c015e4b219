"""Log files by path, time and size.

The listing frame has path, length and modificationTime, as the binaryFile
source gives them; file contents are never read for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import col, int_div
from ..functions.times import calendar

# Suffixes of log files, and the size of a compressed log entry in bytes.
LOG_SUFFIXES = [".gz", ".json"]
COMPRESSED_ENTRY_BYTES = 150


def list_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "modificationTime")


def modified_between(files: DataFrame, start, end) -> DataFrame:
    """Both bounds included."""
    return files.where(F.col("modificationTime").between(F.lit(start), F.lit(end)))


def is_log_file(path) -> Column:
    return col(path).endswith(LOG_SUFFIXES[0]) | col(path).endswith(LOG_SUFFIXES[1])


def log_files(files: DataFrame) -> DataFrame:
    return files.where(is_log_file("path"))


def file_time_from_path(path) -> Column:
    """Hour of a /YYYY/MM/DD/HH/ path, null if there is none."""
    digits = F.regexp_extract(col(path), r"/(2\d{3}/\d{2}/\d{2}/\d{2})/", 1)
    return F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyy/MM/dd/HH"))


def file_time_from_name(path) -> Column:
    """Minute of the _YYYYMMDDTHHMMZ_ part of a file name, null if there is none."""
    digits = F.regexp_extract(col(path), r"_(\d{8}T\d{4})Z_[^/]*$", 1)
    return F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMdd'T'HHmm"))


def files_in_range(files: DataFrame, start, end) -> DataFrame:
    """Files whose hour overlaps [start, end]; paths without an hour are left out."""
    hour = file_time_from_path("path")
    return files.withColumn("file_time", hour).where(
        (F.col("file_time") >= F.date_trunc("hour", F.lit(start))) & (F.col("file_time") <= F.lit(end))
    )


def _joined(base: Column, suffix: Column) -> Column:
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), suffix, F.lit("/"))


def day_prefixes(ranges: DataFrame) -> DataFrame:
    """Rows (base_prefix, start, end) to one row per day prefix base/YYYY/MM/DD/."""
    days = calendar(ranges, "start", "end", "day", "day").select("base_prefix", "day")
    return days.withColumn("prefix", _joined(F.col("base_prefix"), F.date_format("day", "yyyy/MM/dd")))


def hour_prefixes(ranges: DataFrame) -> DataFrame:
    """One row per hour prefix base/YYYY/MM/DD/HH/, 24 for every day touched."""
    end = F.date_trunc("day", "end") + F.expr("INTERVAL 23 HOUR")
    hours = calendar(ranges.withColumns({"start": F.date_trunc("day", "start"), "end": end}), "start", "end", "hour", "hour").select("base_prefix", "hour")
    return hours.withColumn("prefix", _joined(F.col("base_prefix"), F.date_format("hour", "yyyy/MM/dd/HH")))


def estimate_volume(files: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Size, file count and estimated events of the log files of a listing."""
    size = F.coalesce(F.sum("length"), F.lit(0)).cast("bigint")
    totals = log_files(files).agg(size.alias("total_size_bytes"), F.count(F.lit(1)).alias("total_objects"))
    mega = F.lit(1024 * 1024).cast("bigint")
    return totals.select(
        "total_size_bytes",
        "total_objects",
        (int_div(F.col("total_size_bytes") * 200 + mega, mega * 2).cast("double") / 100.0).alias("total_size_mb"),
        int_div(F.col("total_size_bytes"), F.lit(COMPRESSED_ENTRY_BYTES).cast("bigint")).alias("estimated_events"),
        prefixes.agg(F.count(F.lit(1))).scalar().alias("date_prefixes_scanned"),
    )


def base_prefix_from_key(key) -> Column:
    """Path before the first segment of four digits, empty if there is none."""
    k = col(key)
    before = F.regexp_extract(k, r"^((?:[^/]*/)*?)\d{4}(?:/|$)", 1)
    return F.when(F.regexp_like(k, F.lit(r"(?:^|/)\d{4}(?:/|$)")), F.concat(F.rtrim(before, F.lit("/")), F.lit("/"))).otherwise("")


def common_prefix(low: Column, high: Column) -> Column:
    """Longest common prefix of two texts. For a whole group it is that of its
    smallest and its largest text."""
    sizes = F.sequence(F.lit(0), F.least(F.length(low), F.length(high)))
    same = F.filter(sizes, lambda n: F.left(low, n) == F.left(high, n))
    return F.left(low, F.array_max(same))


def base_prefix(keys: DataFrame, group: str, key: str = "path") -> DataFrame:
    """Base prefix per group: from its first key, else what all keys share."""
    ends = keys.groupBy(group).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    found = base_prefix_from_key("low")
    shared = common_prefix(F.col("low"), F.col("high"))
    chosen = F.when(found != "", found).otherwise(shared)
    closed = F.when((chosen != "") & ~chosen.endswith("/"), F.concat(chosen, F.lit("/"))).otherwise(chosen)
    return ends.select(group, closed.alias("base_prefix"))
