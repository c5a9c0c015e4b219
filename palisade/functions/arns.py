"""Resource names: splitting and classifying them by their text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col

# Prefixes and markers inside resource names.
ACL_ARN_PREFIX = "arn:aws:wafv2:"
BUCKET_ARN_PREFIX = "arn:aws:s3:::"
ARN_PARTS = ["arn", "partition", "service", "region", "account_id", "resource"]


def last_segment(c, separator: str = "/") -> Column:
    return F.split_part(col(c), F.lit(separator), F.lit(-1))


def acl_id(c) -> Column:
    """Last path segment of a full ACL name; a bare id stays as it is."""
    return F.when(col(c).startswith(ACL_ARN_PREFIX), last_segment(c)).otherwise(col(c))


def parse_arn(c) -> Column:
    """Struct of the six parts, the rest of the text staying in the last one;
    null when there are fewer."""
    parts = F.split(col(c), ":", 6)
    fields = F.struct(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(ARN_PARTS)])
    return F.when(F.size(parts) >= 6, fields)


def resource_type(c) -> Column:
    arn = col(c)
    return (
        F.when(arn.contains("elasticloadbalancing") & arn.contains("loadbalancer/app/"), "ALB")
        .when(arn.contains("apigateway"), "API_GATEWAY")
        .when(arn.contains("cloudfront"), "CLOUDFRONT")
        .otherwise("UNKNOWN")
    )


def resource_short_name(c) -> Column:
    return F.when(col(c).contains("/"), last_segment(c)).otherwise(last_segment(c, ":"))


def destination_type(c) -> Column:
    arn = col(c)
    return (
        F.when(arn.contains("logs:"), "CLOUDWATCH")
        .when(arn.contains("s3:"), "S3")
        .when(arn.contains("firehose:"), "FIREHOSE")
        .otherwise("UNKNOWN")
    )


def log_group(c) -> Column:
    """Struct (region, log_group) of a log-group name, null if it is none."""
    arn = col(c)
    parts = F.split(arn, ":")
    name = F.regexp_replace(F.split_part(arn, F.lit(":log-group:"), F.lit(2)), "[:*]+$", "")
    return F.when(
        (F.size(parts) >= 6) & arn.contains(":log-group:"),
        F.struct(F.get(parts, F.lit(3)).alias("region"), name.alias("log_group")),
    )


def bucket(c) -> Column:
    """Struct (bucket, prefix): text before and after the first slash."""
    path = F.replace(col(c), F.lit(BUCKET_ARN_PREFIX), F.lit(""))
    parts = F.split(path, "/", 2)
    return F.struct(
        F.get(parts, F.lit(0)).alias("bucket"),
        F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("prefix"),
    )
