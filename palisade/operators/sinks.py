"""Writing raw logs, tables and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arns
from ..functions.numbers import col
from ..functions.records import filled


def safe_name(c) -> Column:
    """Source name for a path: outer slashes dropped, odd characters to _."""
    trimmed = F.regexp_replace(col(c), "^/+|/+$", "")
    return F.coalesce(filled(F.regexp_replace(trimmed, "[^A-Za-z0-9._-]", "_")), F.lit("default"))


def acl_partition(acl) -> Column:
    """Partition value of an ACL: last path segment with / and : replaced,
    unknown when there is none."""
    name = F.coalesce(filled(arns.last_segment(acl)), F.lit("unknown"))
    return F.regexp_replace(name, "[/:]", "_")


def balanced(df: DataFrame, *keys: str) -> DataFrame:
    """Gather rows by folder for few files per folder. Adaptive execution splits
    a hot folder over several tasks and joins small ones."""
    return df.hint("rebalance", *keys)


def write_raw(df: DataFrame, path: str, text: str = "value", compression: str = "none") -> None:
    df.select(F.col(text).alias("value")).write.option("compression", compression).text(path)


def write_raw_by_acl(df: DataFrame, path: str, text: str = "value", acl: str = "web_acl_id") -> None:
    """One folder per ACL."""
    rows = df.select(F.col(text).alias("value"), acl_partition(acl).alias("web_acl_name"))
    balanced(rows, "web_acl_name").write.partitionBy("web_acl_name").text(path)


def write_table(df: DataFrame, path: str, by_day: bool = False) -> None:
    """Parquet, by day for the log table so that time filters prune folders."""
    if not by_day:
        df.write.parquet(path)
        return
    dated = df.withColumn("dt", F.to_date("timestamp"))
    balanced(dated, "dt").sortWithinPartitions("dt", "web_acl_id", "action").write.partitionBy("dt").parquet(path)


def write_hourly(df: DataFrame, path: str, profile: str, text: str = "value", flat_day: bool = True, gzip: bool = True) -> None:
    """Layout profile/acl/YYYY-MM-DD/HH, or profile/acl/YYYY/MM/DD/HH."""
    day = ["dt"] if flat_day else ["yyyy", "mm", "dd"]
    parts = {
        "profile": F.lit(profile),
        "web_acl": acl_partition("web_acl_id"),
        "dt": F.date_format("timestamp", "yyyy-MM-dd"),
        "yyyy": F.date_format("timestamp", "yyyy"),
        "mm": F.date_format("timestamp", "MM"),
        "dd": F.date_format("timestamp", "dd"),
        "hh": F.date_format("timestamp", "HH"),
    }
    keys = ["profile", "web_acl", *day, "hh"]
    rows = df.select(F.col(text).alias("value"), *[parts[k].alias(k) for k in keys])
    balanced(rows, *keys).write.partitionBy(*keys).option("compression", "gzip" if gzip else "none").text(path)


def write_documents(df: DataFrame, path: str, text: str, key: str) -> None:
    balanced(df.select(F.col(text).alias("value"), F.col(key)), key).write.partitionBy(key).text(path, lineSep="\n")


def write_each(df: DataFrame, path: str, text: str, key: str) -> None:
    """The same for a folder per document, or few. What takes time is the number of folders,
    not their bytes, so they are dealt out by name over all tasks; adaptive execution would
    put small texts in one."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    df.select(F.col(text).alias("value"), F.col(key)).repartition(parts, key).write.partitionBy(key).text(path, lineSep="\n")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Texts by folder. Many folders are listed by a few tasks for each core, where Spark
    would start one for each folder up to ten thousand."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, min(int(before), 8 * spark.sparkContext.defaultParallelism))
    try:
        return spark.read.text(path)
    finally:
        spark.conf.set(name, before)
