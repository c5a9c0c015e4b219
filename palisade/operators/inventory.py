"""Joins of the configuration tables.

Nothing here carries a broadcast hint: the tables are small in practice, and
Spark broadcasts a side only when its measured size is under the threshold.
Counts per ACL are made before joining, so a hot ACL never meets the join row
by row; lists come out as numbered rows instead of one array per ACL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arns, labels
from ..functions.numbers import count_when, pct2
from .metrics import n_rows
from .ordering import number_rows


def per_acl(table: DataFrame, name: str) -> DataFrame:
    return table.groupBy("web_acl_id").agg(n_rows().alias(name))


def with_count(acls: DataFrame, table: DataFrame, name: str) -> DataFrame:
    return acls.join(per_acl(table, name), "web_acl_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))


def log_groups_by_acl(acls: DataFrame, logging: DataFrame) -> DataFrame:
    """Log groups of ACLs that log there; names that are no log group are dropped."""
    found = logging.where(F.col("destination_type") == "CLOUDWATCH").join(acls.select("web_acl_id", "name"), "web_acl_id")
    parsed = found.withColumn("g", arns.log_group("destination_arn")).where(F.col("g").isNotNull())
    return parsed.select("g.log_group", F.col("name").alias("web_acl_name"), "web_acl_id", "g.region")


def resources_named(resources: DataFrame, acls: DataFrame) -> DataFrame:
    names = acls.select("web_acl_id", F.col("name").alias("web_acl_name"))
    named = resources.join(names, "web_acl_id", "left")
    return named.withColumn("web_acl_name", F.coalesce("web_acl_name", F.lit("Unknown")))


def acl_inventory(acls: DataFrame, rules: DataFrame, resources: DataFrame, logging: DataFrame) -> DataFrame:
    counted = with_count(with_count(acls, rules, "rules_count"), resources, "resources_count")
    logged = logging.select("web_acl_id").distinct().withColumn("logging", F.lit("Yes"))
    return counted.join(logged, "web_acl_id", "left").select(
        "name", "web_acl_id", "scope",
        labels.default_action_label("default_action").alias("default_action"),
        "capacity", "rules_count", "resources_count",
        F.coalesce("logging", F.lit("No")).alias("logging"),
    )


def rules_named(rules: DataFrame, acls: DataFrame) -> DataFrame:
    """Every rule with the name of its ACL and its listed action."""
    names = acls.select("web_acl_id", F.col("name").alias("web_acl_name"))
    named = rules.join(names, "web_acl_id", "left")
    return named.select(
        F.coalesce("web_acl_name", "web_acl_id").alias("web_acl_name"),
        "name", "priority", "rule_type",
        labels.rule_action_detail("action").alias("action"),
    )


def first_k(table: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """First k rows per key with their number. The rank limit is applied in
    every task before the shuffle, so a hot key sends k rows per task."""
    window = Window.partitionBy(key).orderBy(*order)
    return table.withColumn("position", F.row_number().over(window)).where(F.col("position") <= k)


def first_k_and_rest(table: DataFrame, key: str, order: list[str], k: int) -> DataFrame:
    """The same with the number of rows left out. `rest` comes from a count per key."""
    sizes = table.groupBy(key).agg(n_rows().alias("total"))
    return first_k(table, key, order, k).join(sizes, key).withColumn(
        "more", F.greatest(F.col("total") - k, F.lit(0))
    )


def acl_summary(acls: DataFrame, rules: DataFrame, resources: DataFrame, logging: DataFrame, k: int = 3) -> DataFrame:
    """One line per ACL: rules, the first k resources by name, how many more, logging type."""
    shown = resources.withColumn(
        "text", F.concat_ws(": ", "resource_type", arns.resource_short_name("resource_arn"))
    )
    first = first_k(shown, "web_acl_id", ["resource_arn"], k).groupBy("web_acl_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda r: r["text"]), "; ").alias("resources")
    )
    kinds = logging.groupBy("web_acl_id").agg(F.min("destination_type").alias("logging_type"))
    counted = with_count(with_count(acls, rules, "rules_count"), resources, "resources_count")
    return (
        counted.join(first, "web_acl_id", "left")
        .join(kinds, "web_acl_id", "left")
        .select(
            "web_acl_id", "name", "scope", "capacity", "rules_count", "resources_count",
            F.coalesce("resources", F.lit("None")).alias("resources"),
            F.greatest(F.col("resources_count") - k, F.lit(0)).alias("more_resources"),
            F.coalesce("logging_type", F.lit("Not configured")).alias("logging"),
        )
    )


def acl_rule_list(acls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules of every ACL as numbered rows by priority and name; an ACL without
    rules has one row with no rule."""
    numbered = number_rows(
        rules.select("web_acl_id", "priority", F.col("name").alias("rule_name"), "rule_type", "rule_id"),
        ["priority", "rule_name", "rule_id"], "position", ["web_acl_id"],
    )
    counted = with_count(acls.select("web_acl_id", "name"), rules, "rules_count")
    return counted.join(numbered, "web_acl_id", "left").select(
        "web_acl_id", "name", "rules_count", "position", "rule_name", "rule_type", "priority"
    )


def resources_by_acl(resources: DataFrame, acls: DataFrame) -> DataFrame:
    """Resources under the name of their ACL, numbered by resource name."""
    named = resources_named(resources, acls).select("web_acl_name", "resource_arn", "resource_type", "association_id")
    return number_rows(named, ["resource_arn", "association_id"], "position", ["web_acl_name"]).drop("association_id")


def acls_with_logging(acls: DataFrame, logging: DataFrame) -> DataFrame:
    return acls.join(logging.select("web_acl_id"), "web_acl_id", "left_semi")


def logs_with_acl(logs: DataFrame, acls: DataFrame) -> DataFrame:
    """Requests with the name and scope of their ACL. If the ACLs do not fit a
    broadcast, adaptive execution splits a hot ACL's partition."""
    return logs.join(acls.select("web_acl_id", F.col("name").alias("acl_name"), F.col("scope").alias("acl_scope")), "web_acl_id")


def traffic_per_acl(logs: DataFrame, acls: DataFrame) -> DataFrame:
    """Counts per known ACL: reduced per ACL before the join."""
    counts = logs.groupBy("web_acl_id").agg(
        n_rows().alias("total_requests"), count_when(F.col("action") == "BLOCK").alias("blocked_requests")
    )
    return logs_with_acl(counts, acls)


def unused_rules(rules: DataFrame, logs: DataFrame) -> DataFrame:
    """Configured rules that no request ended at."""
    hit = logs.where(F.col("terminating_rule_id").isNotNull()).select(
        "web_acl_id", F.col("terminating_rule_id").alias("name")
    ).distinct()
    return rules.join(hit, ["web_acl_id", "name"], "left_anti").select("web_acl_id", "name", "rule_type", "priority")


def acl_complete(acls: DataFrame, resources: DataFrame, logging: DataFrame) -> DataFrame:
    """Every ACL with each of its resources, taken apart, its counts and whether it logs."""
    counted = with_count(acls.select("web_acl_id", "name"), resources, "resource_count")
    logged = logging.select("web_acl_id").distinct().withColumn("logging_enabled", F.lit(True))
    arn = arns.parse_arn("resource_arn")
    detail = resources.select("web_acl_id", "resource_arn", arns.resource_type("resource_arn").alias("resource_type"), arn.alias("p"))
    return (
        counted.join(logged, "web_acl_id", "left")
        .join(detail, "web_acl_id", "left")
        .select(
            "web_acl_id", "name", "resource_count",
            F.coalesce("logging_enabled", F.lit(False)).alias("logging_enabled"),
            "resource_arn", "resource_type", "p.service", "p.region", "p.account_id", "p.resource",
        )
    )


def acl_complexity(acls: DataFrame, rules: DataFrame) -> DataFrame:
    """Per ACL: rules, capacity and what kinds of rules it has."""
    kind = lambda t: count_when(F.col("rule_type") == t)
    kinds = rules.groupBy("web_acl_id").agg(
        n_rows().alias("total_rules"),
        kind("MANAGED_RULE_GROUP").alias("managed_rule_groups"),
        (kind("RATE_BASED") > 0).alias("has_rate_limiting"),
        (kind("GEO_MATCH") > 0).alias("has_geo_blocking"),
        (kind("IP_SET") > 0).alias("has_ip_filtering"),
        F.countDistinct("rule_type").alias("rule_type_count"),
    )
    flag = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    number = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return acls.join(kinds, "web_acl_id", "left").select(
        "web_acl_id", number("total_rules"), F.coalesce("capacity", F.lit(0)).cast("bigint").alias("capacity_used"),
        number("managed_rule_groups"), number("rule_type_count"),
        flag("has_rate_limiting"), flag("has_geo_blocking"), flag("has_ip_filtering"),
        labels.default_action_label("default_action").alias("default_action"),
    )


def rule_type_histogram(rules: DataFrame) -> DataFrame:
    return rules.groupBy("web_acl_id", "rule_type").agg(n_rows().alias("count"))


def rules_by_type(rules: DataFrame) -> DataFrame:
    kinds = rules.groupBy(F.coalesce("rule_type", F.lit("UNKNOWN")).alias("rule_type")).agg(n_rows().alias("count"))
    return kinds.withColumn("percentage", pct2(F.col("count"), rules.agg(n_rows()).scalar()))


def rules_by_action(rules: DataFrame) -> DataFrame:
    """Share of all rules, also of those whose action is empty and not counted."""
    label = labels.rule_action_label("action").alias("rule_action")
    kinds = rules.select(label).where(F.col("rule_action").isNotNull()).groupBy("rule_action").agg(n_rows().alias("count"))
    return kinds.withColumn("percentage", pct2(F.col("count"), rules.agg(n_rows()).scalar()))


def cost_metrics(acls: DataFrame, rules: DataFrame, logging: DataFrame) -> DataFrame:
    managed = F.upper(F.coalesce("rule_type", F.lit(""))).contains("MANAGED")
    return rules.agg(n_rows().alias("total_rules"), count_when(managed).alias("managed_rule_groups")).select(
        "total_rules", "managed_rule_groups",
        acls.agg(F.coalesce(F.sum(F.coalesce("capacity", F.lit(0))), F.lit(0)).cast("bigint")).scalar().alias("estimated_capacity_wcu"),
        logging.agg(n_rows()).scalar().alias("logging_enabled_web_acls"),
    )


def managed_rules(rules: DataFrame) -> DataFrame:
    """The managed rule groups behind the cost figure, one row each."""
    managed = rules.where(F.upper(F.coalesce("rule_type", F.lit(""))).contains("MANAGED"))
    name: Column = F.coalesce(F.nullif("name", F.lit("")), "rule_id")
    return managed.select("web_acl_id", name.alias("rule"))


def acls_sorted(acls: DataFrame) -> DataFrame:
    return acls.orderBy("scope", "name", "web_acl_id")
