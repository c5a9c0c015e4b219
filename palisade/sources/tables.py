"""Stored tables, several sources at once, and free SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_table(table: DataFrame, acl_ids: list[str] | None = None, column: str = "web_acl_id") -> DataFrame:
    """The whole table, or the rows of the given ACLs. Ids are values, never SQL text."""
    return table if acl_ids is None else table.where(F.col(column).isin(list(acl_ids)))


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """All rows of several sources in one frame, nothing deduplicated. Columns
    a source lacks are null."""
    tagged = [df.withColumn("source_name", F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def drop_duplicate_records(records: DataFrame, text: str = "value") -> DataFrame:
    """Keep one of several equal raw records, for sources fetched twice."""
    digest = F.sha2(F.col(text), 256)
    return records.withColumn("_digest", digest).dropDuplicates(["_digest"]).drop("_digest")


def run_sql(spark: SparkSession, query: str, views: dict[str, DataFrame], args: list | dict | None = None) -> DataFrame:
    """Free SQL with bound parameters over named frames."""
    for name, frame in views.items():
        frame.createOrReplaceTempView(name)
    return spark.sql(query, args=args)
