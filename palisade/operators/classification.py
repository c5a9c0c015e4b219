"""Report tables derived from the metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.numbers import pct1_text, pct2, percent_text, share, thousands
from . import metrics


def geo_threat_level(logs: DataFrame, n: int = 30) -> DataFrame:
    """Blocked countries with a threat level from the unrounded block rate."""
    geo = metrics.blocked_by_country(logs)
    rate = share("blocked_requests", "total_requests")
    level = labels.threat_level(rate, F.col("blocked_requests"))
    rows = geo.withColumn("threat_level", level).withColumn(
        "risk_assessment", labels.lookup(F.col("threat_level"), labels.THREAT_TEXTS)
    )
    return metrics.top(rows, "blocked_requests", n, "country")


def threat_band(logs: DataFrame) -> DataFrame:
    geo = metrics.geo_distribution(logs).select("country", "threat_score")
    return geo.withColumn("band", labels.band(F.col("threat_score"), [(50, "danger"), (25, "warning")], "normal"))


def order_fixed(logs: DataFrame) -> DataFrame:
    """Known actions in report order."""
    counts = metrics.action_distribution(logs)
    place = F.array_position(F.array(*map(F.lit, labels.ACTIONS)), F.col("action"))
    return counts.withColumn("ord", place.cast("int")).where(F.col("ord") > 0).orderBy("ord")


# Impact and advice per action.
IMPACTS = {
    "BLOCK": "High Security",
    "ALLOW": "Low Security",
    "COUNT": "Monitoring Only",
    "CAPTCHA": "Medium Security",
    "CHALLENGE": "Medium Security",
}
BLOCK_ADVICE = " of traffic blocked - ensure legitimate traffic is not impacted"
ALLOW_ADVICE = " allowed - verify rules are properly configured"
COUNT_ADVICE = "Consider converting to BLOCK if threats are confirmed"
OTHER_ADVICE = "Good balance of security and user experience"


def action_impact(logs: DataFrame) -> DataFrame:
    action, rate = F.col("action"), pct1_text("count", "total")
    advice = (
        F.when(action == "BLOCK", F.concat(rate, F.lit(BLOCK_ADVICE)))
        .when(action == "ALLOW", F.concat(rate, F.lit(ALLOW_ADVICE)))
        .when(action == "COUNT", F.lit(COUNT_ADVICE))
        .otherwise(F.lit(OTHER_ADVICE))
    )
    counts = order_fixed(logs).withColumn("total", metrics.of_all("count"))
    return counts.select(
        "ord", "action", "count", "percentage", labels.lookup(action, IMPACTS).alias("impact"), advice.alias("recommendation")
    )


def rule_status(logs: DataFrame, n: int = 50) -> DataFrame:
    rules = metrics.top(metrics.rule_effectiveness(logs), "hit_count", n, "rule_id", "rule_type")
    effectiveness, status = labels.rule_status(F.col("hit_count"), F.col("block_rate_percent"))
    return rules.select(
        "rule_id", "rule_type", "hit_count", "blocks", "allows", "block_rate_percent",
        effectiveness.alias("effectiveness"), status.alias("status"),
    )


def hit_rate_band(logs: DataFrame) -> DataFrame:
    rate = F.col("hit_rate_percent")
    band = F.when(rate == 0, "danger").when(rate > 10, "success").otherwise("normal")
    return metrics.rule_effectiveness(logs).select("rule_id", "rule_type", "hit_rate_percent", band.alias("band"))


def executive_kpis(logs: DataFrame, acls: DataFrame, logging: DataFrame, resources: DataFrame) -> DataFrame:
    """Eight labelled figures as (ord, metric, value) rows."""
    cover = metrics.as_row(metrics.coverage(acls, logging, resources)).alias("c")
    both = metrics.summary(logs).select("*", cover).select("*", "c.*")
    # Labels, in report order.
    figures = [
        ("Total Requests Analyzed", thousands("total_requests")),
        ("Blocked Requests", thousands("blocked_requests")),
        ("Block Rate", percent_text("block_rate_percent", 2)),
        ("Unique Client IPs", thousands("unique_client_ips")),
        ("Unique Countries", thousands("unique_countries")),
        ("Web ACLs Configured", F.col("total_web_acls").cast("string")),
        ("Protected Resources", F.col("total_protected_resources").cast("string")),
        ("Logging Coverage", percent_text("logging_coverage_percent", 1)),
    ]
    rows = [F.struct(F.lit(i).alias("ord"), F.lit(m).alias("metric"), v.alias("value")) for i, (m, v) in enumerate(figures, 1)]
    return both.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def rule_review_flags(logs: DataFrame, unused: DataFrame) -> DataFrame:
    """Rules and countries to look at: unused, low or high block rate, risky origin."""
    rules = metrics.rule_effectiveness(logs)
    rate = F.col("block_rate_percent")
    rule_flag = F.when(rate < 1, "low_performing").when(rate < 5, "below_five_percent").when(rate > 80, "high")
    flagged = rules.select(F.lit("rule").alias("kind"), F.col("rule_id").alias("subject"), F.col("rule_type").alias("detail"), rule_flag.alias("flag"))
    geo = metrics.geo_distribution(logs)
    risky = geo.where(F.col("threat_score") > 75).select(
        F.lit("country").alias("kind"), F.col("country").alias("subject"), F.lit(None).cast("string").alias("detail"),
        F.lit("high_risk").alias("flag"),
    )
    idle = unused.select(F.lit("rule").alias("kind"), F.col("name").alias("subject"), F.col("web_acl_id").alias("detail"), F.lit("unused").alias("flag"))
    return flagged.where(F.col("flag").isNotNull()).unionByName(risky).unionByName(idle)


def optimized_rule_order(logs: DataFrame, n: int = 10) -> DataFrame:
    """The n most hit rules with the priority their rank suggests."""
    best = metrics.top(metrics.rule_effectiveness(logs), "hit_count", n, "rule_id", "rule_type")
    rank = F.row_number().over(Window.orderBy(F.desc("hit_count"), "rule_id", F.asc_nulls_last("rule_type")))
    return best.select(
        F.col("rule_id").alias("rule"), "rule_type", rank.alias("suggested_priority"), "hit_count", "block_rate_percent"
    )


def posture_score(logs: DataFrame, acls: DataFrame, logging: DataFrame, resources: DataFrame) -> DataFrame:
    """Score from 0 to 100. Penalties use the rounded rates. The share of rules
    without hits is over rules seen in the logs, which all have hits."""
    counts = logs.agg(metrics.n_rows().alias("n"), metrics.acted("BLOCK").alias("b"))
    cover = metrics.as_row(metrics.coverage(acls, logging, resources)).alias("c")
    facts = counts.select(pct2("b", "n").alias("block_rate"), cover).select(
        "block_rate", "c.logging_coverage_percent", "c.total_protected_resources"
    )
    cover, rate, guarded = F.col("logging_coverage_percent"), F.col("block_rate"), F.col("total_protected_resources")
    penalty = (
        F.when(cover < 50, 30).when(cover < 75, 15).when(cover < 100, 5).otherwise(0)
        + F.when(rate > 50, 20).when(rate > 30, 10).when(rate < 0.1, 15).otherwise(0)
        + F.when(guarded == 0, 30).when(guarded < 3, 15).otherwise(0)
    )
    score = F.greatest(F.lit(0), F.lit(100) - penalty).cast("bigint")
    return facts.withColumn("score", score).withColumn(
        "band", F.when(F.col("score") >= 80, "good").when(F.col("score") >= 60, "fair").otherwise("poor")
    )
