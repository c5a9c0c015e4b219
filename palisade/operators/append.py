"""Appending logs, migrating ids, retention and table sizes."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arns
from .ordering import number_rows


def append_logs(existing: DataFrame | None, batch: DataFrame, order: list[str]) -> DataFrame:
    """The batch with log_id continuing after the largest stored one, or from 0,
    in input order."""
    numbered = number_rows(batch, order, "log_id", start=0)
    if existing is None:
        return numbered
    after = existing.agg(F.coalesce(F.max("log_id") + 1, F.lit(0)).cast("bigint")).scalar()
    return numbered.withColumn("log_id", F.col("log_id") + after)


def migrate_acl_ids(logs: DataFrame) -> DataFrame:
    """Full ACL names rewritten to ids, with a flag on the rows that changed."""
    old = F.col("web_acl_id")
    return logs.withColumn("migrated", F.coalesce(old.startswith(arns.ACL_ARN_PREFIX), F.lit(False))).withColumn(
        "web_acl_id", arns.acl_id("web_acl_id")
    )


def retain(logs: DataFrame, as_of: datetime, days: int) -> DataFrame:
    """Rows of the last `days` days; zero or less keeps all."""
    if days <= 0:
        return logs
    cutoff = F.lit(as_of - timedelta(days=days))
    kept = logs.where(F.col("timestamp") >= cutoff)
    return kept.where(F.col("dt") >= F.to_date(cutoff)) if "dt" in logs.columns else kept


def table_stats(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n, df in tables.items()]
    stats = counts[0]
    for c in counts[1:]:
        stats = stats.unionByName(c)
    return stats
