"""One mergeable roll-up of the log, from which every report comes.

A row stands for the requests of one ACL, hour, action, rule, client and country, with
their number, their first and last time and how many have fingerprints; further rows count
an ACL's requests by hour and user agent. Rows of different batches need only be put
together: counts add up, times have a smallest and a largest, and distinct clients and
countries are columns. Stored by day, a batch touches its own days only.

The metrics take a roll-up in place of a log (`metrics.tally`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

ACL = "web_acl_id"
SHARED = [ACL, "hour"]
CLIENT = ["action", "terminating_rule_id", "terminating_rule_type", "client_ip", "country"]
AGENT = ["user_agent"]
#: set apart by `kind`: requests, or requests by user agent
REQUESTS, AGENTS = "requests", "agents"


def roll_up(logs: DataFrame) -> DataFrame:
    """The roll-up of a log, read once: both groupings come from one pass."""
    rows = logs.select(
        ACL, F.date_trunc("hour", "timestamp").alias("hour"), *CLIENT, *AGENT, "timestamp",
        F.col("ja3_fingerprint").isNotNull().cast("int").alias("ja3"), F.col("ja4_fingerprint").isNotNull().cast("int").alias("ja4"),
    )
    keys = [*SHARED, *CLIENT, *AGENT]
    grouped = rows.groupingSets([[*SHARED, *CLIENT], [*SHARED, *AGENT]], *keys).agg(
        F.when(F.grouping("user_agent") == 1, REQUESTS).otherwise(AGENTS).alias("kind"), F.count(F.lit(1)).alias("requests"),
        F.sum("ja3").alias("ja3_requests"), F.sum("ja4").alias("ja4_requests"), F.min("timestamp").alias("timestamp"), F.max("timestamp").alias("last_timestamp"),
    )
    return grouped.where((F.col("kind") == REQUESTS) | F.col("user_agent").isNotNull())


def compact(rollup: DataFrame) -> DataFrame:
    """A roll-up of several batches with one row for each key again."""
    return rollup.groupBy("kind", *SHARED, *CLIENT, *AGENT).agg(
        *[F.sum(c).alias(c) for c in ("requests", "ja3_requests", "ja4_requests")], F.min("timestamp").alias("timestamp"), F.max("last_timestamp").alias("last_timestamp"),
    ).select(*rollup.columns)


def extend(logs: DataFrame, path: str, version: int | None = None) -> int:
    """Add a batch of logs to the stored roll-up. Only its days are written again."""
    return store.append_days(roll_up(logs), path, version, days=logs)


def read(spark: SparkSession, path: str) -> DataFrame:
    return store.read(spark, path)


def requests(rollup: DataFrame) -> DataFrame:
    return rollup.where(F.col("kind") == REQUESTS)


def agents(rollup: DataFrame) -> DataFrame:
    return rollup.where(F.col("kind") == AGENTS)
