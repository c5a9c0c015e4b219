"""Keyed upserts of the configuration tables.

Plain files have no MERGE: the new table is the old rows and the batch together,
the latest version of each key kept. `version` orders whole batches, `position`
the rows inside one. Versions are compared as aggregates, so copies of a hot key
are reduced before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arns
from ..functions.numbers import col


def latest_per_key(rows: DataFrame, key: str, order: list[str], keep_first: list[str] | None = None, first_by: list[str] | None = None) -> DataFrame:
    """Last row per key in `order`. Columns in `keep_first` keep the value of the
    first row instead, in `first_by` order if that is another."""
    kept = keep_first or []
    others = [c for c in rows.columns if c != key and c not in kept]
    latest = rows.groupBy(key).agg(
        F.max_by(F.struct(*others), F.struct(*order)).alias("_r"),
        *[F.min_by(c, F.struct(*(first_by or order))).alias(c) for c in kept],
    )
    return latest.select(key, "_r.*", *kept).select(*rows.columns)


def upsert(old: DataFrame | None, batch: DataFrame, key: str, order: list[str], keep_first: list[str] | None = None) -> DataFrame:
    """The table after the batch. Kept columns come from the stored row where
    there is one, so that applying a batch again changes nothing."""
    rows = batch.withColumn("_new", F.lit(1))
    if old is not None:
        rows = old.withColumn("_new", F.lit(0)).unionByName(rows)
    return latest_per_key(rows, key, order, keep_first, ["_new", *order]).drop("_new")


def acl_rows(config: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Dump columns to table columns of web_acls, with their defaults, and with a moment
    also the times of load: a stored row keeps its created_at (see `TABLES`)."""
    rows = config.select(
        F.col("Id").alias("web_acl_id"),
        F.col("Name").alias("name"),
        F.col("Scope").alias("scope"),
        F.coalesce("DefaultAction", F.lit("{}")).alias("default_action"),
        F.coalesce("Description", F.lit("")).alias("description"),
        F.coalesce("VisibilityConfig", F.lit("{}")).alias("visibility_config"),
        F.coalesce("Capacity", F.lit(0)).cast("bigint").alias("capacity"),
        F.coalesce("ManagedByFirewallManager", F.lit(False)).alias("managed_by_firewall_manager"),
        *[c for c in config.columns if c in ORDER],
    )
    return rows if as_of is None else rows.withColumns({"created_at": as_of, "updated_at": as_of})


#: columns that order the rows of one dump and are not stored
ORDER = ["dump", "position"]
#: key and kept columns of each stored configuration table
TABLES = {
    "web_acls": ("web_acl_id", ["created_at"]),
    "rules": ("rule_id", []),
    "resource_associations": ("association_id", []),
    "logging_configurations": ("config_id", []),
}


def rule_rows(rules: DataFrame, as_of: Column) -> DataFrame:
    """Rules of a dump (`extract_rules`) to table columns of rules. A rule without a name
    has the key of an unknown one."""
    return rules.select(
        rule_key().alias("rule_id"), "web_acl_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("priority", F.lit(0)).alias("priority"),
        "rule_type", "action", "visibility_config", "statement", as_of.alias("created_at"), *[c for c in ORDER if c in rules.columns],
    )


def resource_rows(resources: DataFrame, as_of: Column) -> DataFrame:
    """Resources of a dump (`resources_of_scope`) to table columns of resource_associations."""
    return resources.select(resource_key().alias("association_id"), "web_acl_id", "resource_arn", "resource_type", as_of.alias("created_at"), *[c for c in ORDER if c in resources.columns])


def rule_key(acl="web_acl_id", name="name") -> Column:
    return F.concat_ws("_", col(acl), F.coalesce(col(name), F.lit("unknown")))


def resource_key(acl="web_acl_id", arn="resource_arn") -> Column:
    return F.concat_ws("_", col(acl), col(arn))


def logging_rows(dump: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Explode destinations and classify them. Two of one type on one ACL get one key; the
    later position wins in the upsert. With a moment, also the fields that are left out of
    the logs, as JSON text, and the time of load."""
    redacted = F.coalesce("redacted_fields", F.lit("[]")) if "redacted_fields" in dump.columns else F.lit("[]")
    each = dump.select(
        "web_acl_id",
        F.posexplode("destinations").alias("position", "destination_arn"),
        F.coalesce("log_format", F.lit("JSON")).alias("log_format"),
        F.coalesce("sampling_rate", F.lit(1.0)).alias("sampling_rate"),
        *([] if as_of is None else [redacted.alias("redacted_fields"), as_of.alias("created_at")]),
    )
    kind = arns.destination_type("destination_arn")
    return each.withColumn("destination_type", kind).withColumn(
        "config_id", F.concat_ws("_", "web_acl_id", "destination_type")
    )
