"""Several reports from one pass over a log or a stored roll-up of it.

Each request is counted under every report it belongs to: one row for each (kind, item),
reduced where the log is read. Reports of different lengths, and overlapping windows of
time, are then the same few rows seen several times.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from .filters import UNKNOWN_COUNTRY
from .metrics import last_time, tally, took


def _kinds(agents: bool) -> dict[str, Column]:
    """The item of each kind that a request counts under; null for none."""
    blocked = F.col("action") == "BLOCK"
    kinds = {
        "actions": F.coalesce("action", F.lit("")),
        "geo": F.when(F.col("country") != UNKNOWN_COUNTRY, F.col("country")),
        "rules": F.col("terminating_rule_id"),
        "ips": F.when(blocked, F.col("client_ip")),
        "daily": F.date_format("timestamp", "yyyy-MM-dd"),
        "hourly": F.date_format("timestamp", "HH"),
    }
    return kinds | ({"agents": F.col("user_agent")} if agents else {})


def item_counts(logs: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """kind, item, total, blocked, allowed: requests under each item of each kind. Rows of a
    stored roll-up that count by user agent give that kind, those of a log give all."""
    rolled = "kind" in logs.columns
    if rolled:
        logs = logs.withColumnRenamed("kind", "grain")
    wanted = {k: c for k, c in _kinds(True).items() if kinds is None or k in kinds}
    grain = lambda k: F.lit(True) if not rolled else (F.col("grain") == ("agents" if k == "agents" else "requests"))
    pairs = F.array(*[F.when(grain(k) & c.isNotNull(), F.struct(F.lit(k).alias("kind"), c.alias("item"))) for k, c in wanted.items()])
    each = logs.withColumn("x", F.explode(F.array_compact(pairs))).withColumns({"kind": F.col("x.kind"), "item": F.col("x.item")})
    return each.groupBy("kind", "item").agg(tally(logs).alias("total"), took(logs, "BLOCK").alias("blocked"), took(logs, "ALLOW").alias("allowed"))


#: reports in the order of their items, not of their counts
IN_ORDER = ("daily", "hourly")


def ranked(counts: DataFrame, lengths: dict[str, list[int]]) -> DataFrame:
    """report (kind_length), item, position, total, blocked, allowed: the first items of each
    kind for each of its lengths, most requests first, ties by item. Ranks are cut at the
    longest report in every task, before the kinds meet."""
    longest = max(n for v in lengths.values() for n in v)
    order = [F.when(F.col("kind").isin(*IN_ORDER), 0).otherwise(-F.col("total")), F.col("item")]
    first = counts.withColumn("position", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).where(F.col("position") <= longest)
    reports = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("n")) for k, v in lengths.items() for n in v])
    own = F.filter(reports, lambda r: (r["kind"] == F.col("kind")) & (r["n"] >= F.col("position")))
    return first.withColumn("r", F.explode(own)).select(F.concat_ws("_", "kind", F.col("r.n").cast("string")).alias("report"), "item", "position", "total", "blocked", "allowed")


def top_reports(logs: DataFrame, lengths: dict[str, list[int]]) -> DataFrame:
    """report, item, value for all kinds and lengths. `blocked_geo` counts the blocked
    requests of the countries that have some. Hours are numbers, as they are shown."""
    counts = item_counts(logs, [k for k in _kinds(True) if k in lengths or k == "geo" and "blocked_geo" in lengths])
    blocked = F.struct(F.lit("blocked_geo").alias("kind"), F.col("blocked").alias("total"))
    both = F.array(F.struct("kind", "total"), F.when((F.col("kind") == "geo") & (F.col("blocked") > 0), blocked))
    each = counts.withColumn("x", F.explode(F.array_compact(both))).select("x.kind", "item", "x.total", "blocked", "allowed")
    wanted = each.where(F.col("kind").isin(*lengths))
    hour = F.when(F.startswith("report", F.lit("hourly")), F.col("item").cast("int").cast("string")).otherwise(F.col("item"))
    return ranked(wanted, lengths).select("report", hour.alias("item"), F.col("total").alias("value"))


def chart_series(logs: DataFrame, most: int = 15) -> DataFrame:
    """Inputs of the six charts in one long frame (chart, label, series, value), from one
    pass. Attack labels are added up over the few rules."""
    counts = item_counts(logs, ["actions", "geo", "rules", "daily", "hourly"])
    kind, label = F.col("kind"), F.col("item")
    pair = lambda chart, text, **values: F.struct(
        F.lit(chart).alias("chart"), text.alias("label"), *[(values[n] if n in values else F.lit(None).cast("bigint")).alias(n) for n in ("total", "blocked", "allowed")])
    total, blocked, allowed = F.col("total"), F.col("blocked"), F.col("allowed")
    shown = F.array(
        F.when(kind == "actions", pair("action_pie", label, total=total)),
        F.when(kind == "daily", pair("daily_lines", label, total=total, blocked=blocked, allowed=allowed)),
        F.when((kind == "geo") & (blocked > 0), pair("geo_bars", label, blocked=blocked)),
        F.when((kind == "rules") & (blocked > 0), pair("attack_bars", labels.attack_of_rule("item"), total=blocked)),
        F.when(kind == "hourly", pair("hourly_bars", label.cast("int").cast("string"), total=total, blocked=blocked)),
        F.when(kind == "rules", pair("rule_bars", label, total=total, blocked=blocked)),
    )
    charts = counts.select(F.explode(F.array_compact(shown)).alias("c")).select("c.*")
    added = charts.groupBy("chart", "label").agg(*[F.sum(n).alias(n) for n in ("total", "blocked", "allowed")])
    cut = F.col("chart").isin("geo_bars", "rule_bars")
    order = Window.partitionBy("chart").orderBy(F.desc(F.coalesce("total", "blocked")), "label")
    best = added.withColumn("position", F.row_number().over(order)).where(~cut | (F.col("position") <= most))
    names = {"action_pie": ["count"], "daily_lines": ["total", "blocked", "allowed"], "geo_bars": [None, "blocked"], "attack_bars": ["count"],
             "hourly_bars": ["total", "blocked"], "rule_bars": ["hits", "blocks"]}
    series = [F.when(F.col("chart") == c, F.struct(F.lit(n).alias("series"), F.col(measure).alias("value")))
              for c, own in names.items() for n, measure in zip(own, ("total", "blocked", "allowed")) if n]
    return best.select("chart", "label", F.explode(F.array_compact(F.array(*series))).alias("s")).select("chart", "label", "s.series", "s.value")


def in_windows(logs: DataFrame, windows: dict[str, tuple[datetime, datetime]]) -> DataFrame:
    """time_window, requests, first_seen, last_seen of each window, bounds included; windows
    may overlap. A log is read once, and only between the first bound and the last; a table
    stored by day (column dt) only in the days between. A roll-up can stand in where bounds
    are whole hours."""
    low, high = min(a for a, _ in windows.values()), max(b for _, b in windows.values())
    when = F.col("timestamp")
    found = logs.where(when.between(F.lit(low), F.lit(high)))
    if "dt" in logs.columns:
        found = found.where(F.col("dt").between(F.to_date(F.lit(low)), F.to_date(F.lit(high))))
    own = F.array_compact(F.array(*[F.when(when.between(F.lit(a), F.lit(b)), F.lit(name)) for name, (a, b) in windows.items()]))
    counts = found.withColumn("time_window", F.explode(own)).groupBy("time_window").agg(
        tally(logs).alias("requests"), F.min("timestamp").alias("first_seen"), last_time(logs).alias("last_seen"))
    names = logs.sparkSession.createDataFrame([(n,) for n in windows], "time_window string")
    return names.join(counts, "time_window", "left").withColumn("requests", F.coalesce("requests", F.lit(0)))
