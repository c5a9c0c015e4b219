"""Configuration dumps: ACLs with their rules, protected resources, logging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import arns, labels
from ..functions.records import filled

# Resource types asked for per scope.
SCOPE_RESOURCES = {
    "REGIONAL": [
        "APPLICATION_LOAD_BALANCER", "API_GATEWAY", "APPSYNC", "COGNITO_USER_POOL",
        "APP_RUNNER_SERVICE", "VERIFIED_ACCESS_INSTANCE",
    ],
    "CLOUDFRONT": ["CLOUDFRONT"],
}


def scan_acl_config(spark: SparkSession, paths: str | list[str], scope: str) -> DataFrame:
    return spark.read.schema(schemas.ACL_CONFIG).json(paths).withColumn("Scope", F.lit(scope))


def read_acl_text(texts: DataFrame, scope: Column, *kept: str) -> DataFrame:
    """The same from one dump per row in column `value`."""
    parsed = F.from_json("value", schemas.ACL_CONFIG)
    return texts.select(parsed.alias("c"), scope.alias("Scope"), *kept).select("c.*", "Scope", *kept)


def extract_rules(acls: DataFrame, *kept: str) -> DataFrame:
    """One row per rule, with its place in the dump, its type and, for managed
    groups, vendor, name and version."""
    rules = acls.select(F.col("Id").alias("web_acl_id"), F.posexplode("Rules").alias("position", "r"), *kept)
    group = "$.ManagedRuleGroupStatement"
    return rules.select(
        "web_acl_id",
        "position",
        F.col("r.Name").alias("name"),
        F.col("r.Priority").alias("priority"),
        F.coalesce("r.Action", F.lit("{}")).alias("action"),
        F.coalesce("r.Statement", F.lit("{}")).alias("statement"),
        F.coalesce("r.VisibilityConfig", F.lit("{}")).alias("visibility_config"),
        labels.rule_type("r.Statement").alias("rule_type"),
        F.get_json_object("r.Statement", f"{group}.VendorName").alias("vendor_name"),
        F.get_json_object("r.Statement", f"{group}.Name").alias("group_name"),
        F.get_json_object("r.Statement", f"{group}.Version").alias("group_version"),
        *kept,
    )


def resources_of_scope(associations: DataFrame, scope: Column) -> DataFrame:
    """Resource names per ACL for the resource types of its scope."""
    types = F.when(scope == "CLOUDFRONT", F.array(*map(F.lit, SCOPE_RESOURCES["CLOUDFRONT"]))).otherwise(
        F.array(*map(F.lit, SCOPE_RESOURCES["REGIONAL"]))
    )
    arn = F.explode("ResourceArns").alias("resource_arn")
    found = associations.where(F.array_contains(types, F.col("ResourceType")))
    return found.select(F.col("WebAclId").alias("web_acl_id"), F.col("ResourceType").alias("listed_type"), arn).withColumn(
        "resource_type", arns.resource_type("resource_arn")
    )


def discover_log_sources(acls: DataFrame, logging: DataFrame) -> DataFrame:
    """Every ACL with a logging destination: its first destination, what kind of
    source that is, and why it cannot be used where it is incomplete."""
    first = logging.select("web_acl_id", F.get("destinations", F.lit(0)).alias("destination_arn"))
    found = acls.join(first.where(F.col("destination_arn").isNotNull()), "web_acl_id")
    arn = F.col("destination_arn")
    parts = F.split(arn, ":")
    kind = F.when(arn.contains(":s3:"), "s3").when(arn.contains(":logs:"), "cloudwatchlogs").otherwise("")
    bucket = F.when((F.col("source_type") == "s3") & (F.size(parts) >= 6), F.split_part(F.get(parts, F.lit(5)), F.lit("/"), F.lit(1)))
    group = F.when((F.col("source_type") == "cloudwatchlogs") & (F.size(parts) >= 7), F.get(parts, F.lit(6)))
    reason = (
        F.when(filled("name").isNull(), "missing name")
        .when(filled("web_acl_id").isNull(), "missing id")
        .when(F.col("source_type") == "", "unsupported source type")
        .when((F.col("source_type") == "s3") & filled("bucket").isNull(), "missing bucket")
        .when((F.col("source_type") == "cloudwatchlogs") & filled("log_group").isNull(), "missing log group")
    )
    return (
        found.select("web_acl_id", "name", "scope", "destination_arn", kind.alias("source_type"))
        .withColumns({"bucket": bucket, "log_group": group})
        .withColumn("reject_reason", reason)
    )
