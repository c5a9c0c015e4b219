"""Security metrics over the log table.

Each is one grouping over a narrow projection: partial aggregation runs before
every shuffle, so a hot rule, country or client is reduced where it is read.
A stored roll-up (`rollup.py`) can stand in for the log in those that reports are made of.
Exact distinct counts over one column are planned by (key, value) first, which
spreads a hot key over its values. Top-N results end in a bounded heap per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.numbers import count_when, pct2
from ..functions.times import calendar
from .filters import UNKNOWN_COUNTRY, blocked, known_country, not_null


def n_rows() -> Column:
    return F.count(F.lit(1))


def acted(action: str) -> Column:
    return count_when(F.col("action") == action)


def tally(logs: DataFrame, condition: Column | None = None) -> Column:
    """How many requests, of those that meet the condition: rows of a log, or what the rows
    of a roll-up stand for."""
    if "requests" not in logs.columns:
        return n_rows() if condition is None else count_when(condition)
    weight = F.col("requests") if condition is None else F.when(condition, F.col("requests"))
    return F.coalesce(F.sum(weight), F.lit(0)).cast("bigint")


def took(logs: DataFrame, action: str) -> Column:
    return tally(logs, F.col("action") == action)


def last_time(logs: DataFrame) -> Column:
    return F.max("last_timestamp" if "last_timestamp" in logs.columns else "timestamp")


def summary(logs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Totals, counts per action, block rate, distinct clients and countries and
    the time range in one scan. Each distinct count is combined per value before
    the shuffle, so only distinct values travel."""
    totals = logs.groupBy(*keys).agg(
        tally(logs).alias("total_requests"),
        took(logs, "BLOCK").alias("blocked_requests"),
        took(logs, "ALLOW").alias("allowed_requests"),
        took(logs, "COUNT").alias("counted_requests"),
        took(logs, "CAPTCHA").alias("captcha_requests"),
        took(logs, "CHALLENGE").alias("challenge_requests"),
        F.countDistinct("client_ip").alias("unique_client_ips"),
        F.countDistinct(F.when(F.col("country") != UNKNOWN_COUNTRY, F.col("country"))).alias("unique_countries"),
        F.min("timestamp").alias("start_time"),
        last_time(logs).alias("end_time"),
    )
    return totals.withColumn("block_rate_percent", pct2("blocked_requests", "total_requests"))


def batch_summary(logs: DataFrame) -> DataFrame:
    """Summary of one parsed batch with the count of every action; here the unknown-country
    mark counts as a country, and empty texts do not count."""
    named = {"blocked": "BLOCK", "allowed": "ALLOW", "counted": "COUNT", "captcha": "CAPTCHA", "challenge": "CHALLENGE"}
    return logs.agg(
        n_rows().alias("total_entries"),
        *[acted(a).alias(n) for n, a in named.items()],
        F.count_if(~F.col("action").isin(list(named.values())) | F.col("action").isNull()).alias("other_actions"),
        F.countDistinct(F.nullif("client_ip", F.lit(""))).alias("unique_ips"),
        F.countDistinct(F.nullif("country", F.lit(""))).alias("unique_countries"),
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
    ).withColumn("block_rate", pct2("blocked", "total_entries"))


def action_distribution(logs: DataFrame) -> DataFrame:
    counts = logs.groupBy("action").agg(n_rows().alias("count"))
    return with_share(counts, "count", "percentage")


def total_rows(logs: DataFrame) -> Column:
    """Row count of the whole frame as a scalar subquery: one row, no join."""
    return logs.agg(n_rows()).scalar()


def as_row(one: DataFrame) -> Column:
    """A one-row frame as a scalar struct: one subquery for all its columns."""
    return one.select(F.struct(*one.columns)).scalar()


def of_all(count: str, keys: tuple[str, ...] = ()) -> Column:
    """The sum of the groups' counts, for all groups or those of each key: the log is not
    read again for its total. There are as many rows as groups, not as logs."""
    return F.sum(count).over(Window.partitionBy(*keys))


def with_share(groups: DataFrame, count: str, name: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Share of each group in the sum of all."""
    return groups.withColumn(name, pct2(F.col(count), of_all(count, keys)))


def rule_effectiveness(logs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per terminating rule. The hit rate is over all requests, with and without a rule."""
    rules = (
        logs.groupBy(*keys, "terminating_rule_id", "terminating_rule_type")
        .agg(
            tally(logs).alias("hit_count"),
            F.countDistinct("client_ip").alias("unique_ips"),
            took(logs, "BLOCK").alias("blocks"),
            took(logs, "ALLOW").alias("allows"),
            took(logs, "COUNT").alias("counts"),
        )
        .withColumnsRenamed({"terminating_rule_id": "rule_id", "terminating_rule_type": "rule_type"})
    )
    # logs without a rule are a group too until the shares are known
    rules = not_null(with_share(rules, "hit_count", "hit_rate_percent", keys), "rule_id")
    return rules.withColumn("block_rate_percent", pct2("blocks", "hit_count"))


def geo_distribution(logs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return (
        known_country(logs)
        .groupBy(*keys, "country")
        .agg(
            tally(logs).alias("total_requests"),
            took(logs, "BLOCK").alias("blocked_requests"),
            took(logs, "ALLOW").alias("allowed_requests"),
            F.countDistinct("client_ip").alias("unique_ips"),
        )
        .withColumn("threat_score", pct2("blocked_requests", "total_requests"))
    )


def blocked_ips(logs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Blocked clients; a client without country is a group of its own."""
    return (
        blocked(logs, also="client_ip")
        .groupBy(*keys, "client_ip", "country")
        .agg(
            tally(logs).alias("block_count"),
            F.countDistinct("terminating_rule_id").alias("unique_rules_hit"),
            F.min("timestamp").alias("first_seen"),
            last_time(logs).alias("last_seen"),
        )
        .withColumnRenamed("client_ip", "ip")
    )


def top(df: DataFrame, by: str, n: int, *tie: str) -> DataFrame:
    """First n rows by a measure, ties broken by key, nulls last."""
    return df.orderBy(F.desc(by), *[F.asc_nulls_last(t) for t in tie]).limit(n)


def top_blocked_ips(logs: DataFrame, n: int = 50) -> DataFrame:
    return top(blocked_ips(logs), "block_count", n, "ip", "country")


def attack_types(logs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Blocked requests per attack label: per rule first, labels on the few rules."""
    per_rule = blocked(logs, also="terminating_rule_id").groupBy(*keys, "terminating_rule_id").agg(tally(logs).alias("n"))
    labelled = per_rule.withColumn("attack_type", labels.attack_of_rule("terminating_rule_id"))
    return labelled.groupBy(*keys, "attack_type").agg(F.sum("n").cast("bigint").alias("count"))


def hourly_patterns(logs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return (
        logs.groupBy(*keys, F.hour("timestamp").alias("hour"))
        .agg(tally(logs).alias("total_requests"), took(logs, "BLOCK").alias("blocked"), took(logs, "ALLOW").alias("allowed"))
        .withColumn("block_rate_percent", pct2("blocked", "total_requests"))
    )


def daily_trends(logs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return (
        logs.groupBy(*keys, F.to_date("timestamp").alias("date"))
        .agg(
            tally(logs).alias("total_requests"),
            took(logs, "BLOCK").alias("blocked"),
            took(logs, "ALLOW").alias("allowed"),
            F.countDistinct("client_ip").alias("unique_ips"),
        )
        .withColumn("block_rate_percent", pct2("blocked", "total_requests"))
    )


def coverage(acls: DataFrame, logging: DataFrame, resources: DataFrame) -> DataFrame:
    """Configured ACLs, those with logging, and resources. No ACL filter applies."""
    return acls.agg(n_rows().alias("total_web_acls")).select(
        "total_web_acls",
        logging.agg(F.countDistinct("web_acl_id")).scalar().alias("web_acls_with_logging"),
        resources.agg(n_rows()).scalar().alias("total_protected_resources"),
    ).withColumn("logging_coverage_percent", pct2("web_acls_with_logging", "total_web_acls"))


def resources_by_type(resources: DataFrame) -> DataFrame:
    return resources.groupBy("resource_type").agg(n_rows().alias("count"))


def bot_counts(logs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    rolled = "ja3_requests" in logs.columns
    counted = lambda j: F.coalesce(F.sum(f"{j}_requests"), F.lit(0)) if rolled else F.count(f"{j}_fingerprint")
    return logs.groupBy(*keys).agg(counted("ja3").alias("requests_with_ja3"), counted("ja4").alias("requests_with_ja4"))


def user_agents(logs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return not_null(logs, "user_agent").groupBy(*keys, "user_agent").agg(tally(logs).alias("count"))


def top_user_agents(logs: DataFrame, n: int = 20) -> DataFrame:
    return top(user_agents(logs), "count", n, "user_agent")


def blocked_geo_summary(logs: DataFrame) -> DataFrame:
    geo = geo_distribution(logs).where(F.col("blocked_requests") > 0)
    # the smallest of the struct is the largest count, ties by country
    best = F.min(F.struct((-F.col("blocked_requests")).alias("n"), F.col("country").alias("c")))
    return geo.agg(
        F.coalesce(F.sum("blocked_requests"), F.lit(0)).cast("bigint").alias("total_blocked"),
        n_rows().alias("countries_with_blocks"),
        best.alias("b"),
    ).select(
        "total_blocked", "countries_with_blocks",
        F.coalesce("b.c", F.lit("N/A")).alias("top_country"),
        F.coalesce(-F.col("b.n"), F.lit(0)).cast("bigint").alias("top_country_blocked"),
    )


def blocks_by_day_rule(logs: DataFrame) -> DataFrame:
    days = blocked(logs).groupBy(F.to_date("timestamp").alias("date"), "terminating_rule_id")
    return days.agg(n_rows().alias("blocks"))


def client_activity(logs: DataFrame) -> DataFrame:
    clients = not_null(logs, "client_ip").groupBy("client_ip")
    return clients.agg(n_rows().alias("total_requests"), acted("BLOCK").alias("blocked_requests")).withColumn(
        "block_rate", pct2("blocked_requests", "total_requests")
    )


def blocked_by_country(logs: DataFrame) -> DataFrame:
    countries = known_country(logs).groupBy("country")
    counts = countries.agg(n_rows().alias("total_requests"), acted("BLOCK").alias("blocked_requests"))
    return counts.where(F.col("blocked_requests") > 0).withColumn("block_rate", pct2("blocked_requests", "total_requests"))


def action_share(logs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """ALLOW, BLOCK and COUNT as shares of their own sum."""
    counts = logs.groupBy(*keys).agg(*[acted(a).alias(a.lower()) for a in ("ALLOW", "BLOCK", "COUNT")])
    whole = F.greatest(F.col("allow") + F.col("block") + F.col("count"), F.lit(1))
    return counts.withColumns({f"{a}_percent": pct2(F.col(a), whole) for a in ("allow", "block", "count")})


def default_rule_share(logs: DataFrame, default_rule: str = "Default_Action") -> DataFrame:
    counts = logs.agg(
        n_rows().alias("total_requests"), count_when(F.col("terminating_rule_id") == default_rule).alias("default_requests")
    )
    return counts.withColumn("default_percent", pct2("default_requests", "total_requests"))


def hourly_filled(logs: DataFrame) -> DataFrame:
    """Requests of every hour between the first and the last, empty hours as 0."""
    hours = logs.groupBy(F.date_trunc("hour", "timestamp").alias("hour")).agg(
        n_rows().alias("n"), acted("BLOCK").alias("b")
    )
    ends = hours.agg(F.min("hour").alias("a"), F.max("hour").alias("z")).where(F.col("a").isNotNull())
    every = calendar(ends, "a", "z", "hour", "hour").select("hour")
    return every.join(hours, "hour", "left").select(
        "hour", F.coalesce("n", F.lit(0)).alias("total_requests"), F.coalesce("b", F.lit(0)).alias("blocked")
    )
