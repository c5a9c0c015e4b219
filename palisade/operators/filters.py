"""Row filters shared by the metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: country code of an unknown origin.
UNKNOWN_COUNTRY = "-"


def of_acls(logs: DataFrame, acl_ids: list[str] | DataFrame | None) -> DataFrame:
    """None keeps all. A list becomes a pushed-down IN; a frame a semi join."""
    if acl_ids is None:
        return logs
    if isinstance(acl_ids, DataFrame):
        return logs.join(acl_ids, "web_acl_id", "left_semi")
    return logs.where(F.col("web_acl_id").isin(list(acl_ids)))


def not_null(logs: DataFrame, column: str) -> DataFrame:
    return logs.where(F.col(column).isNotNull())


def known_country(logs: DataFrame) -> DataFrame:
    return logs.where(F.col("country").isNotNull() & (F.col("country") != UNKNOWN_COUNTRY))


def blocked(logs: DataFrame, also: str | None = None) -> DataFrame:
    found = logs.where(F.col("action") == "BLOCK")
    return not_null(found, also) if also else found


def in_window(logs: DataFrame, start, end) -> DataFrame:
    """Both bounds included, as the named windows are. A table stored by day
    (column dt) is pruned to the days of the window."""
    found = logs.where(F.col("timestamp").between(F.lit(start), F.lit(end)))
    return found.where(F.col("dt").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))) if "dt" in logs.columns else found
