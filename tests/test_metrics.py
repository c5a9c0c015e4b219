"""The recorded 159-request run, and sums that must agree."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palisade.functions import labels, numbers, times
from palisade.operators import classification, filters, inventory, metrics
from palisade.workload import views

DAY = datetime(2025, 11, 7)


def request(at, action, rule, ip, agent):
    return (at, "acl-1", action, ip, "VN", rule, "REGULAR", "ja3", "ja4", agent)


SCHEMA = ("timestamp timestamp, web_acl_id string, action string, client_ip string, country string, terminating_rule_id string, "
          "terminating_rule_type string, ja3_fingerprint string, ja4_fingerprint string, user_agent string")


@pytest.fixture(scope="module")
def golden(spark):
    rows = []
    for hour, n in ((15, 72), (17, 70), (18, 15)):
        first = DAY + timedelta(hours=hour) + (timedelta(minutes=47, seconds=49, milliseconds=132) if hour == 15 else timedelta())
        rows += [request(first + timedelta(seconds=i), "ALLOW", "office-allow", "198.51.100.10", "a" if len(rows) + i < 109 else "b") for i in range(n)]
    for ms in (357, 439):
        rows.append(request(DAY + timedelta(hours=20, minutes=55, seconds=58, milliseconds=ms), "BLOCK", "Default_Action", "203.0.113.21", "c"))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def setup(spark):
    acls = spark.createDataFrame([("acl-1", "one", 10), ("acl-2", "two", 20)], "web_acl_id string, name string, capacity bigint")
    logging = spark.createDataFrame([("acl-1_S3", "acl-1", "S3")], "config_id string, web_acl_id string, destination_type string")
    resources = spark.createDataFrame([], "web_acl_id string, resource_type string")
    return acls, logging, resources


def one(df):
    return df.first().asDict()


def test_summary(golden):
    row = one(metrics.summary(golden))
    assert (row["total_requests"], row["blocked_requests"], row["allowed_requests"]) == (159, 2, 157)
    assert (row["block_rate_percent"], row["unique_client_ips"], row["unique_countries"]) == (1.26, 2, 1)
    assert row["start_time"] == DAY + timedelta(hours=15, minutes=47, seconds=49, milliseconds=132)
    assert row["end_time"] == DAY + timedelta(hours=20, minutes=55, seconds=58, milliseconds=439)


def test_actions(golden):
    assert {r.action: (r["count"], r.percentage) for r in metrics.action_distribution(golden).collect()} == {
        "ALLOW": (157, 98.74), "BLOCK": (2, 1.26)}


def test_rules(golden):
    rules = {r.rule_id: r for r in metrics.rule_effectiveness(golden).collect()}
    assert (rules["office-allow"].hit_rate_percent, rules["office-allow"].block_rate_percent) == (98.74, 0.0)
    assert (rules["Default_Action"].hit_rate_percent, rules["Default_Action"].block_rate_percent) == (1.26, 100.0)


def test_hours_and_days(golden):
    assert {r.hour: r.total_requests for r in metrics.hourly_patterns(golden).collect()} == {15: 72, 17: 70, 18: 15, 20: 2}
    days = metrics.daily_trends(golden).collect()
    assert [(r.date.isoformat(), r.total_requests) for r in days] == [("2025-11-07", 159)]
    filled = {r.hour.hour: r.total_requests for r in metrics.hourly_filled(golden).collect()}
    assert filled == {15: 72, 16: 0, 17: 70, 18: 15, 19: 0, 20: 2}


def test_clients_attacks_agents(golden):
    top = metrics.top_blocked_ips(golden).collect()
    assert [(r.ip, r.block_count, r.unique_rules_hit) for r in top] == [("203.0.113.21", 2, 1)]
    assert [(r.attack_type, r["count"]) for r in metrics.attack_types(golden).collect()] == [("Other", 2)]
    assert one(metrics.bot_counts(golden)) == {"requests_with_ja3": 159, "requests_with_ja4": 159}
    assert [r["count"] for r in metrics.top_user_agents(golden).collect()] == [109, 48, 2]


def test_coverage_and_score(golden, setup):
    row = one(metrics.coverage(*setup))
    assert (row["total_web_acls"], row["logging_coverage_percent"], row["total_protected_resources"]) == (2, 50.0, 0)
    # 15 for half the logging, none for the block rate, 30 for no resources
    assert one(classification.posture_score(golden, *setup))["score"] == 55


def test_empty_log(spark, setup):
    empty = spark.createDataFrame([], SCHEMA)
    row = one(metrics.summary(empty))
    assert (row["total_requests"], row["block_rate_percent"], row["start_time"]) == (0, 0.0, None)
    assert metrics.hourly_filled(empty).count() == 0
    assert one(metrics.blocked_geo_summary(empty))["top_country"] == "N/A"


def test_sums_agree(spark, data):
    logs = views.logs(spark, data)
    total = logs.count()
    for frame, column in (
        (metrics.action_distribution(logs), "count"), (metrics.hourly_patterns(logs), "total_requests"), (metrics.daily_trends(logs), "total_requests"),
        (metrics.hourly_filled(logs), "total_requests"),
    ):
        assert frame.agg(F.sum(column)).first()[0] == total
    row = one(metrics.summary(logs))
    assert row["blocked_requests"] + row["allowed_requests"] <= total
    assert sum(row[f"{a}_requests"] for a in ("blocked", "allowed", "counted", "captcha", "challenge")) == total


@pytest.mark.parametrize("part, whole, expected", [(0, 0, 0.0), (1, 3, 33.33), (2, 3, 66.67), (1, 800, 0.13), (159, 159, 100.0), (10**12, 3 * 10**12, 33.33)])
def test_pct2(spark, part, whole, expected):
    assert spark.range(1).select(numbers.pct2(F.lit(part), F.lit(whole))).first()[0] == expected


def test_pct1_text(spark):
    row = spark.range(1).select(numbers.pct1_text(F.lit(1), F.lit(3)), numbers.pct1_text(F.lit(5), F.lit(0)), numbers.pct1_text(F.lit(1), F.lit(1))).first()
    assert list(row) == ["33.3%", "0.0%", "100.0%"]


def test_threat_levels(spark):
    cases = [(80.0, 101, "CRITICAL"), (80.0, 100, "HIGH"), (51.0, 51, "HIGH"), (51.0, 50, "MEDIUM"), (10.0, 101, "MEDIUM"), (25.0, 100, "LOW")]
    df = spark.createDataFrame(cases, "rate double, blocked bigint, want string")
    assert df.where(labels.threat_level(F.col("rate"), F.col("blocked")) != F.col("want")).count() == 0


def test_both_attack_orders(spark):
    df = spark.createDataFrame([("ScriptFilter",), ("CorporateAllow",), ("lfi-scanner",), ("my-reputation",)], "r string")
    got = df.select(labels.attack_of_rule("r"), labels.attack_of_request(F.lit("BLOCK"), "r")).collect()
    assert [tuple(r) for r in got] == [
        ("IP Reputation", "IP Reputation"), ("Rate Limiting", "Rate Limiting"), ("Scanner/Reconnaissance", "File Inclusion"), ("IP Reputation", "Other")]


def test_windows():
    now = datetime(2024, 5, 10, 13, 5)
    assert times.time_window("today", now) == (datetime(2024, 5, 10), now)
    assert times.time_window("yesterday", now)[1] == datetime(2024, 5, 9, 23, 59, 59, 999999)
    assert times.time_window("months", now, months=1)[0] == datetime(2024, 4, 10, 13, 5)
    with pytest.raises(ValueError):
        times.time_window("custom", now, datetime(2024, 2, 2), datetime(2024, 2, 1))


def test_first_k_limits_before_the_shuffle(spark, data):
    ranked = inventory.first_k(views.traffic(spark, data), "web_acl_id", ["timestamp"], 3)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_top_n_never_sorts_everything(spark, data):
    plan = metrics.top_blocked_ips(views.traffic(spark, data))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_summary_reads_the_log_once(spark, data):
    plan = metrics.summary(views.traffic(spark, data))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_acl_filter_takes_values_not_text(spark, golden):
    assert filters.of_acls(golden, ["acl-1' OR '1'='1"]).count() == 0
    assert filters.of_acls(golden, None).count() == 159


def test_metrics_of_a_stored_rollup_equal_those_of_the_log(spark, data, tmp_path):
    """A roll-up stored in three batches, the days of which overlap, gives every report,
    distinct clients too, and stays the same when a batch is stored again."""
    from palisade.operators import rollup
    from palisade.workload import views

    logs, path = views.logs(spark, data), str(tmp_path / "rollup")
    for part in range(3):
        rollup.extend(logs.where(f"log_id % 3 = {part}"), path, version=part)
    rollup.extend(logs.where("log_id % 3 = 2"), path, version=2)
    rolled = rollup.read(spark, path)
    by = ("web_acl_id",)
    key = lambda df: sorted((tuple(r.asDict().values()) for r in df.select(*sorted(df.columns)).collect()), key=repr)
    for frame in (rolled, rollup.compact(rolled)):
        counted = rollup.requests(frame)
        for metric in (metrics.summary, metrics.rule_effectiveness, metrics.geo_distribution, metrics.blocked_ips, metrics.attack_types,
                       metrics.hourly_patterns, metrics.daily_trends, metrics.bot_counts):
            assert key(metric(counted, by)) == key(metric(logs, by)) and key(metric(counted)) == key(metric(logs)), metric
        assert key(metrics.user_agents(rollup.agents(frame), by)) == key(metrics.user_agents(logs, by))
    assert rollup.compact(rolled).count() <= rolled.count()
    assert rollup.roll_up(logs.where("false")).collect() == []


def test_rollup_reads_the_log_once(spark, data):
    from palisade.operators import rollup
    from palisade.workload import views

    plan = rollup.roll_up(views.logs(spark, data))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Expand") == 1 and plan.split("Initial Plan")[0].count("lineitem.parquet") + plan.count("events.parquet") <= 2


def test_reports_read_once_and_take_a_rollup(spark, data, tmp_path):
    from palisade.operators import reports, rollup

    logs, path = views.logs(spark, data), str(tmp_path / "rollup")
    rollup.extend(logs, path)
    rolled = rollup.read(spark, path)
    lengths = {"geo": [3, 5], "rules": [2], "ips": [4, 9], "agents": [3], "daily": [2, 30], "hourly": [24], "blocked_geo": [4]}
    windows = {"a": (datetime(2024, 1, 5), datetime(2024, 1, 9)), "b": (datetime(2024, 1, 5), datetime(2024, 1, 6)), "none": (datetime(1999, 1, 1), datetime(1999, 1, 2))}
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for made in (lambda t: reports.top_reports(t, lengths), reports.chart_series):
        assert rows(made(logs)) == rows(made(rolled)) != []
    got = {r.time_window: (r.requests, r.first_seen, r.last_seen) for r in reports.in_windows(logs, windows).collect()}
    for name, (a, b) in windows.items():
        inside = logs.where(F.col("timestamp").between(F.lit(a), F.lit(b))).agg(F.count("*"), F.min("timestamp"), F.max("timestamp")).first()
        assert got[name] == tuple(inside)
    logs.write.parquet(str(tmp_path / "stored"))
    stored = spark.read.parquet(str(tmp_path / "stored"))
    for made in (reports.top_reports(stored, lengths), reports.chart_series(stored), reports.in_windows(stored, windows)):
        assert made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("FileScan parquet") == 1
    empty = logs.where("false")
    assert reports.top_reports(empty, lengths).collect() == [] and reports.chart_series(empty).collect() == []
