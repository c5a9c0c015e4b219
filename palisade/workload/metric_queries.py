"""Metrics, rankings and report tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import labels, times
from ..functions.numbers import share
from ..operators import classification as cl
from ..operators import filters, inventory, metrics, reports
from . import views as v
from .registry import n_sql, pct2_sql, query

BLOCK, ALLOW, COUNT = "action = 'BLOCK'", "action = 'ALLOW'", "action = 'COUNT'"
KNOWN = "country IS NOT NULL AND country <> '-'"
N = "CAST(count(*) AS BIGINT)"


def summary_sql(source: str) -> str:
    return f"""
    SELECT {N} AS total_requests, {n_sql(BLOCK)} AS blocked_requests, {n_sql(ALLOW)} AS allowed_requests,
      {n_sql(COUNT)} AS counted_requests, {n_sql("action = 'CAPTCHA'")} AS captcha_requests, {n_sql("action = 'CHALLENGE'")} AS challenge_requests,
      count(DISTINCT client_ip) AS unique_client_ips, count(DISTINCT CASE WHEN {KNOWN} THEN country END) AS unique_countries,
      min(timestamp) AS start_time, max(timestamp) AS end_time, {pct2_sql(n_sql(BLOCK), 'count(*)')} AS block_rate_percent
    FROM {source}"""


def actions_sql(source: str) -> str:
    return f"""SELECT action, count, {pct2_sql('count', 'total')} AS percentage
      FROM (SELECT action, {N} AS count FROM {source} GROUP BY action), (SELECT count(*) AS total FROM {source})"""


def rules_sql(source: str) -> str:
    return f"""
    SELECT rule_id, rule_type, hit_count, unique_ips, blocks, allows, counts, {pct2_sql('hit_count', 'total')} AS hit_rate_percent,
      {pct2_sql('blocks', 'hit_count')} AS block_rate_percent
    FROM (SELECT terminating_rule_id AS rule_id, terminating_rule_type AS rule_type, {N} AS hit_count, count(DISTINCT client_ip) AS unique_ips,
        {n_sql(BLOCK)} AS blocks, {n_sql(ALLOW)} AS allows, {n_sql(COUNT)} AS counts
      FROM {source} WHERE terminating_rule_id IS NOT NULL GROUP BY 1, 2), (SELECT count(*) AS total FROM {source})"""


def geo_sql(source: str) -> str:
    return f"""
    SELECT country, {N} AS total_requests, {n_sql(BLOCK)} AS blocked_requests, {n_sql(ALLOW)} AS allowed_requests,
      count(DISTINCT client_ip) AS unique_ips, {pct2_sql(n_sql(BLOCK), 'count(*)')} AS threat_score
    FROM {source} WHERE {KNOWN} GROUP BY country"""


def ips_sql(source: str, n: int) -> str:
    return f"""
    SELECT client_ip AS ip, country, {N} AS block_count, count(DISTINCT terminating_rule_id) AS unique_rules_hit,
      min(timestamp) AS first_seen, max(timestamp) AS last_seen
    FROM {source} WHERE {BLOCK} AND client_ip IS NOT NULL GROUP BY client_ip, country
    ORDER BY block_count DESC, ip, country NULLS LAST LIMIT {n}"""


def attack_case(column: str, tests=labels.ATTACKS_BY_RULE) -> str:
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains(lower({column}), '{f}')" for f in fragments) + f" THEN '{label}'" for label, fragments in tests
    )
    return f"CASE {whens} ELSE 'Other' END"


def attacks_sql(source: str) -> str:
    return f"""SELECT {attack_case('terminating_rule_id')} AS attack_type, {N} AS count FROM {source}
      WHERE {BLOCK} AND terminating_rule_id IS NOT NULL GROUP BY 1"""


def hourly_sql(source: str) -> str:
    return f"""SELECT CAST(extract(hour FROM timestamp) AS INTEGER) AS hour, {N} AS total_requests, {n_sql(BLOCK)} AS blocked, {n_sql(ALLOW)} AS allowed,
      {pct2_sql(n_sql(BLOCK), 'count(*)')} AS block_rate_percent FROM {source} GROUP BY 1"""


def daily_sql(source: str) -> str:
    return f"""SELECT CAST(timestamp AS DATE) AS date, {N} AS total_requests, {n_sql(BLOCK)} AS blocked, {n_sql(ALLOW)} AS allowed,
      count(DISTINCT client_ip) AS unique_ips, {pct2_sql(n_sql(BLOCK), 'count(*)')} AS block_rate_percent FROM {source} GROUP BY 1"""


COUNTRY_BLOCKS = f"""SELECT country, {N} AS total_requests, {n_sql(BLOCK)} AS blocked_requests,
  {pct2_sql(n_sql(BLOCK), 'count(*)')} AS block_rate FROM v_logs WHERE {KNOWN} GROUP BY country HAVING {n_sql(BLOCK)} > 0"""
COVERAGE = f"""SELECT (SELECT count(*) FROM v_acls) AS total_web_acls, (SELECT count(DISTINCT web_acl_id) FROM v_logging) AS web_acls_with_logging,
  (SELECT count(*) FROM v_resources) AS total_protected_resources"""


# the metrics, over both logs
for prefix, view, sql_view in (("", v.logs, "v_logs"), ("traffic_", v.traffic, "v_traffic")):
    query(prefix + "summary_metrics", summary_sql(sql_view))(lambda s, d, view=view: metrics.summary(view(s, d)))
    query(prefix + "action_distribution", actions_sql(sql_view))(lambda s, d, view=view: metrics.action_distribution(view(s, d)))
    query(prefix + "rule_effectiveness", rules_sql(sql_view))(lambda s, d, view=view: metrics.rule_effectiveness(view(s, d)))
    query(prefix + "geo_distribution", geo_sql(sql_view))(lambda s, d, view=view: metrics.geo_distribution(view(s, d)))
    query(prefix + "top_blocked_ips", ips_sql(sql_view, 50))(lambda s, d, view=view: metrics.top_blocked_ips(view(s, d)))
    query(prefix + "attack_types", attacks_sql(sql_view))(lambda s, d, view=view: metrics.attack_types(view(s, d)))
    query(prefix + "hourly_patterns", hourly_sql(sql_view))(lambda s, d, view=view: metrics.hourly_patterns(view(s, d)))
    query(prefix + "daily_trends", daily_sql(sql_view))(lambda s, d, view=view: metrics.daily_trends(view(s, d)))


@query("acl_coverage", f"SELECT *, {pct2_sql('web_acls_with_logging', 'total_web_acls')} AS logging_coverage_percent FROM ({COVERAGE})")
def acl_coverage(s, d):
    return metrics.coverage(v.acls(s, d), v.logging(s, d), v.resources(s, d))


@query("resources_by_type", f"SELECT resource_type, {N} AS count FROM v_resources GROUP BY 1")
def resources_by_type(s, d):
    return metrics.resources_by_type(v.resources(s, d))


@query("bot_counts", "SELECT count(ja3_fingerprint) AS requests_with_ja3, count(ja4_fingerprint) AS requests_with_ja4 FROM v_logs")
def bot_counts(s, d):
    return metrics.bot_counts(v.logs(s, d))


@query("top_user_agents", f"""SELECT user_agent, {N} AS count FROM v_logs WHERE user_agent IS NOT NULL GROUP BY 1
  ORDER BY count DESC, user_agent LIMIT 20""")
def top_user_agents(s, d):
    return metrics.top_user_agents(v.logs(s, d))


@query("posture_score", f"""
SELECT block_rate, logging_coverage_percent, total_protected_resources, CAST(score AS BIGINT) AS score,
  CASE WHEN score >= 80 THEN 'good' WHEN score >= 60 THEN 'fair' ELSE 'poor' END AS band
FROM (SELECT *, greatest(0, 100
    - CASE WHEN logging_coverage_percent < 50 THEN 30 WHEN logging_coverage_percent < 75 THEN 15 WHEN logging_coverage_percent < 100 THEN 5 ELSE 0 END
    - CASE WHEN block_rate > 50 THEN 20 WHEN block_rate > 30 THEN 10 WHEN block_rate < 0.1 THEN 15 ELSE 0 END
    - CASE WHEN total_protected_resources = 0 THEN 30 WHEN total_protected_resources < 3 THEN 15 ELSE 0 END) AS score
  FROM (SELECT {pct2_sql('web_acls_with_logging', 'total_web_acls')} AS logging_coverage_percent, total_protected_resources FROM ({COVERAGE})),
       (SELECT {pct2_sql(n_sql(BLOCK), 'count(*)')} AS block_rate FROM v_logs))""")
def posture_score(s, d):
    return cl.posture_score(v.logs(s, d), v.acls(s, d), v.logging(s, d), v.resources(s, d))


@query("log_batch_summary", f"""
SELECT {N} AS total_entries, {n_sql(BLOCK)} AS blocked, {n_sql("action = 'ALLOW'")} AS allowed, {n_sql("action = 'COUNT'")} AS counted, {n_sql("action = 'CAPTCHA'")} AS captcha,
  {n_sql("action = 'CHALLENGE'")} AS challenge, {n_sql("action IS NULL OR action NOT IN ('BLOCK', 'ALLOW', 'COUNT', 'CAPTCHA', 'CHALLENGE')")} AS other_actions, count(DISTINCT client_ip) AS unique_ips, count(DISTINCT country) AS unique_countries,
  min(timestamp) AS start_time, max(timestamp) AS end_time, {pct2_sql(n_sql(BLOCK), 'count(*)')} AS block_rate FROM v_logs""")
def log_batch_summary(s, d):
    return metrics.batch_summary(v.logs(s, d))


@query("blocked_geo_summary", f"""
SELECT CAST(coalesce(sum(blocked_requests), 0) AS BIGINT) AS total_blocked, {N} AS countries_with_blocks,
  coalesce(first(country ORDER BY blocked_requests DESC, country), 'N/A') AS top_country, coalesce(max(blocked_requests), 0) AS top_country_blocked
FROM ({COUNTRY_BLOCKS})""")
def blocked_geo_summary(s, d):
    return metrics.blocked_geo_summary(v.logs(s, d))


@query("blocks_by_day_rule", f"""
SELECT CAST(timestamp AS DATE) AS date, terminating_rule_id, {N} AS blocks FROM v_logs WHERE {BLOCK} GROUP BY 1, 2""")
def blocks_by_day_rule(s, d):
    return metrics.blocks_by_day_rule(v.logs(s, d)).orderBy("date", F.desc("blocks"))


CLIENTS = f"""SELECT client_ip, {N} AS total_requests, {n_sql(BLOCK)} AS blocked_requests, {pct2_sql(n_sql(BLOCK), 'count(*)')} AS block_rate
  FROM v_logs WHERE client_ip IS NOT NULL GROUP BY 1"""


@query("client_activity", f"{CLIENTS} ORDER BY total_requests DESC, client_ip LIMIT 10")
def client_activity(s, d):
    return metrics.top(metrics.client_activity(v.logs(s, d)), "total_requests", 10, "client_ip")


@query("blocked_by_country", f"{COUNTRY_BLOCKS} ORDER BY blocked_requests DESC, country LIMIT 15")
def blocked_by_country(s, d):
    return metrics.top(metrics.blocked_by_country(v.logs(s, d)), "blocked_requests", 15, "country")


SHARES = ", ".join(
    f"{pct2_sql(a, 'greatest(allow + block + count, 1)')} AS {a}_percent" for a in ("allow", "block", "count")
)


@query("acl_action_share", f"""SELECT web_acl_id, allow, block, count, {SHARES}
FROM (SELECT web_acl_id, {n_sql(ALLOW)} AS allow, {n_sql(BLOCK)} AS block, {n_sql(COUNT)} AS count FROM v_logs GROUP BY 1)""")
def acl_action_share(s, d):
    return metrics.action_share(v.logs(s, d), ("web_acl_id",))


DEFAULT = "terminating_rule_id = 'Default_Action'"


@query("default_rule_share", f"""SELECT {N} AS total_requests, {n_sql(DEFAULT)} AS default_requests,
  {pct2_sql(n_sql(DEFAULT), 'count(*)')} AS default_percent FROM v_logs""")
def default_rule_share(s, d):
    return metrics.default_rule_share(v.logs(s, d))


# filters
AS_OF = datetime(2024, 1, 20, 15, 30)


@query("filter_acls", f"SELECT action, {N} AS count FROM v_logs WHERE web_acl_id IN ('acl-1', 'acl-3', 'acl-retired') GROUP BY 1")
def filter_acls(s, d):
    return filters.of_acls(v.logs(s, d), ["acl-1", "acl-3", "acl-retired"]).groupBy("action").agg(metrics.n_rows().alias("count"))


@query("filter_acls_known", f"SELECT web_acl_id, {N} AS count FROM v_logs WHERE web_acl_id IN (SELECT web_acl_id FROM v_acls) GROUP BY 1")
def filter_acls_known(s, d):
    known = v.acls(s, d).select("web_acl_id")
    return filters.of_acls(v.logs(s, d), known).groupBy("web_acl_id").agg(metrics.n_rows().alias("count"))


@query("filter_not_null", f"SELECT terminating_rule_id, {N} AS count FROM v_logs WHERE client_ip IS NOT NULL AND terminating_rule_id IS NOT NULL GROUP BY 1")
def filter_not_null(s, d):
    logs = filters.not_null(filters.not_null(v.logs(s, d), "client_ip"), "terminating_rule_id")
    return logs.groupBy("terminating_rule_id").agg(metrics.n_rows().alias("count"))


@query("filter_known_country", f"SELECT country, {N} AS count FROM v_logs WHERE {KNOWN} GROUP BY 1")
def filter_known_country(s, d):
    return filters.known_country(v.logs(s, d)).groupBy("country").agg(metrics.n_rows().alias("count"))


@query("filter_blocked", f"SELECT log_id, web_acl_id, client_ip, terminating_rule_id FROM v_logs WHERE {BLOCK} AND client_ip IS NOT NULL")
def filter_blocked(s, d):
    return filters.blocked(v.logs(s, d), also="client_ip").select("log_id", "web_acl_id", "client_ip", "terminating_rule_id")


WINDOWS = {
    "today": ("2024-01-20 00:00:00", "2024-01-20 15:30:00"),
    "yesterday": ("2024-01-19 00:00:00", "2024-01-19 23:59:59.999999"),
    "week": ("2024-01-13 15:30:00", "2024-01-20 15:30:00"),
    "months": ("2023-10-22 15:30:00", "2024-01-20 15:30:00"),
    "custom": ("2024-01-05 06:00:00", "2024-01-07 18:00:00"),
}


@query("time_window_filter", " UNION ALL ".join(
    f"SELECT '{k}' AS time_window, {N} AS requests, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM v_logs WHERE timestamp BETWEEN TIMESTAMP '{a}' AND TIMESTAMP '{b}'"
    for k, (a, b) in WINDOWS.items()))
def time_window_filter(s, d):
    custom = (datetime(2024, 1, 5, 6), datetime(2024, 1, 7, 18))
    return reports.in_windows(v.logs(s, d), {kind: times.time_window(kind, AS_OF, *custom) for kind in WINDOWS})


@query("business_hours", f"SELECT hour(timestamp) >= 9 AND hour(timestamp) < 17 AS in_business_hours, {N} AS requests, {n_sql(BLOCK)} AS blocked FROM v_logs GROUP BY 1")
def business_hours(s, d):
    flag = times.business_hours("timestamp").alias("in_business_hours")
    return v.logs(s, d).groupBy(flag).agg(metrics.n_rows().alias("requests"), metrics.acted("BLOCK").alias("blocked"))


# ranking
RULES = rules_sql("v_logs")


@query("optimized_rule_order", f"""
SELECT rule_id AS rule, rule_type, CAST(row_number() OVER (ORDER BY hit_count DESC, rule_id, rule_type NULLS LAST) AS INTEGER) AS suggested_priority,
  hit_count, block_rate_percent FROM ({RULES}) ORDER BY suggested_priority LIMIT 10""")
def optimized_rule_order(s, d):
    return cl.optimized_rule_order(v.logs(s, d))


@query("first_k_per_acl", """
SELECT web_acl_id, name, rule_type, priority, position, more FROM (SELECT web_acl_id, name, rule_type, priority,
  CAST(row_number() OVER (PARTITION BY web_acl_id ORDER BY priority, rule_id) AS INTEGER) AS position,
  CAST(greatest(count(*) OVER (PARTITION BY web_acl_id) - 5, 0) AS BIGINT) AS more FROM v_rules) WHERE position <= 5""")
def first_k_per_acl(s, d):
    found = inventory.first_k_and_rest(v.rules(s, d), "web_acl_id", ["priority", "rule_id"], 5)
    return found.select("web_acl_id", "name", "rule_type", "priority", "position", "more")


@query("pct_of_total", f"""SELECT rule_type, count, {pct2_sql('count', 'total')} AS percentage
FROM (SELECT rule_type, {N} AS count FROM v_rules GROUP BY 1), (SELECT count(*) AS total FROM v_rules)""")
def pct_of_total(s, d):
    rules = v.rules(s, d)
    counts = rules.groupBy("rule_type").agg(metrics.n_rows().alias("count"))
    return metrics.with_share(counts, "count", "percentage")


@query("numbered_rows", """
SELECT web_acl_id, rule_id, CAST(row_number() OVER (PARTITION BY web_acl_id ORDER BY priority, rule_id) AS BIGINT) AS number FROM v_rules""")
def numbered_rows(s, d):
    from ..operators.ordering import number_rows

    rules = v.rules(s, d).select("web_acl_id", "priority", "rule_id")
    return number_rows(rules, ["priority", "rule_id"], "number", ["web_acl_id"]).drop("priority")


# Rows shown per report.
REPORT_CAPS = [
    ("geo", 20), ("geo", 30), ("geo", 10), ("rules", 50), ("rules", 15), ("rules", 10), ("ips", 50), ("ips", 30), ("ips", 20), ("ips", 10),
    ("agents", 20), ("agents", 15), ("daily", 30), ("hourly", 24), ("blocked_geo", 15),
]
REPORT_SQL = {
    "geo": ("country", "total_requests", "total_requests DESC, country", geo_sql("v_logs")),
    "blocked_geo": ("country", "blocked_requests", "blocked_requests DESC, country", COUNTRY_BLOCKS),
    "rules": ("rule_id", "hit_count", "hit_count DESC, rule_id", f"SELECT rule_id, CAST(sum(hit_count) AS BIGINT) AS hit_count FROM ({RULES}) GROUP BY 1"),
    "ips": ("ip", "block_count", "block_count DESC, ip", f"SELECT client_ip AS ip, {N} AS block_count FROM v_logs WHERE {BLOCK} AND client_ip IS NOT NULL GROUP BY 1"),
    "agents": ("user_agent", "count", "count DESC, user_agent", f"SELECT user_agent, {N} AS count FROM v_logs WHERE user_agent IS NOT NULL GROUP BY 1"),
    "daily": ("date", "total_requests", "date", daily_sql("v_logs")),
    "hourly": ("hour", "total_requests", "hour", hourly_sql("v_logs")),
}


def _report_sql() -> str:
    parts = []
    for name, cap in REPORT_CAPS:
        key, measure, order, body = REPORT_SQL[name]
        parts.append(f"SELECT * FROM (SELECT '{name}_{cap}' AS report, CAST({key} AS VARCHAR) AS item, {measure} AS value FROM ({body}) ORDER BY {order} LIMIT {cap})")
    return " UNION ALL ".join(parts)


@query("topn_report", _report_sql())
def topn_report(s, d):
    lengths: dict[str, list[int]] = {}
    for name, cap in REPORT_CAPS:
        lengths.setdefault(name, []).append(cap)
    return reports.top_reports(v.logs(s, d), lengths)


@query("order_fixed", f"""SELECT * FROM (SELECT action, count, percentage,
  CAST(list_position(['BLOCK', 'ALLOW', 'COUNT', 'CAPTCHA', 'CHALLENGE'], action) AS INTEGER) AS ord FROM ({actions_sql('v_logs')})) WHERE ord IS NOT NULL""")
def order_fixed(s, d):
    return cl.order_fixed(v.logs(s, d))


@query("distinct_sets", """
SELECT 'client_ip' AS kind, client_ip AS value FROM v_logs WHERE client_ip IS NOT NULL GROUP BY 2
UNION ALL SELECT 'country', country FROM v_logs WHERE country IS NOT NULL GROUP BY 2
UNION ALL SELECT 'web_acl_id', web_acl_id FROM v_logs WHERE web_acl_id IS NOT NULL GROUP BY 2""")
def distinct_sets(s, d):
    logs = v.logs(s, d)
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("value")) for c in ("client_ip", "country", "web_acl_id")]))
    return logs.select(pairs.alias("p")).select("p.*").where(F.col("value").isNotNull()).distinct()


# report tables
RATE = "blocked_requests * 100.0 / total_requests"


@query("geo_threat_level", f"""
SELECT country, total_requests, blocked_requests, block_rate, threat_level,
  CASE threat_level {' '.join(f"WHEN '{k}' THEN '{t}'" for k, t in labels.THREAT_TEXTS.items())} END AS risk_assessment
FROM (SELECT *, CASE WHEN {RATE} > 75 AND blocked_requests > 100 THEN 'CRITICAL' WHEN {RATE} > 50 AND blocked_requests > 50 THEN 'HIGH'
    WHEN {RATE} > 25 OR blocked_requests > 100 THEN 'MEDIUM' ELSE 'LOW' END AS threat_level FROM ({COUNTRY_BLOCKS}))
ORDER BY blocked_requests DESC, country LIMIT 30""")
def geo_threat_level(s, d):
    return cl.geo_threat_level(v.logs(s, d))


@query("threat_band", f"""SELECT country, threat_score, CASE WHEN threat_score > 50 THEN 'danger' WHEN threat_score > 25 THEN 'warning' ELSE 'normal' END AS band
FROM ({geo_sql('v_logs')})""")
def threat_band(s, d):
    return cl.threat_band(v.logs(s, d))


@query("action_impact", f"""
SELECT CAST(list_position(['BLOCK', 'ALLOW', 'COUNT', 'CAPTCHA', 'CHALLENGE'], action) AS INTEGER) AS ord, action, count, percentage,
  CASE action WHEN 'BLOCK' THEN 'High Security' WHEN 'ALLOW' THEN 'Low Security' WHEN 'COUNT' THEN 'Monitoring Only' ELSE 'Medium Security' END AS impact,
  CASE action WHEN 'BLOCK' THEN r || '{cl.BLOCK_ADVICE}' WHEN 'ALLOW' THEN r || '{cl.ALLOW_ADVICE}' WHEN 'COUNT' THEN '{cl.COUNT_ADVICE}' ELSE '{cl.OTHER_ADVICE}' END AS recommendation
FROM (SELECT *, CAST(h // 10 AS VARCHAR) || '.' || CAST(h % 10 AS VARCHAR) || '%' AS r
  FROM (SELECT *, (count * 2000 + total) // (2 * total) AS h FROM ({actions_sql('v_logs')}), (SELECT count(*) AS total FROM v_logs)))
WHERE action IN ('BLOCK', 'ALLOW', 'COUNT', 'CAPTCHA', 'CHALLENGE')""")
def action_impact(s, d):
    return cl.action_impact(v.logs(s, d))


@query("rule_status", f"""
SELECT rule_id, rule_type, hit_count, blocks, allows, block_rate_percent,
  CASE WHEN hit_count = 0 THEN 'UNUSED' WHEN block_rate_percent > 80 THEN 'HIGHLY EFFECTIVE' WHEN block_rate_percent > 50 THEN 'EFFECTIVE'
    WHEN block_rate_percent > 20 THEN 'MODERATE' ELSE 'LOW' END AS effectiveness,
  CASE WHEN hit_count = 0 THEN 'Consider removing or reviewing' WHEN block_rate_percent > 80 THEN 'Performing well' WHEN block_rate_percent > 50 THEN 'Good performance'
    WHEN block_rate_percent > 20 THEN 'Review for optimization' ELSE 'May need adjustment' END AS status
FROM ({RULES}) ORDER BY hit_count DESC, rule_id, rule_type NULLS LAST LIMIT 50""")
def rule_status(s, d):
    return cl.rule_status(v.logs(s, d))


@query("hit_rate_band", f"""SELECT rule_id, rule_type, hit_rate_percent,
  CASE WHEN hit_rate_percent = 0 THEN 'danger' WHEN hit_rate_percent > 10 THEN 'success' ELSE 'normal' END AS band FROM ({RULES})""")
def hit_rate_band(s, d):
    return cl.hit_rate_band(v.logs(s, d))


@query("executive_kpis", f"""
SELECT ord, metric, value FROM (SELECT unnest([
  {{'ord': 1, 'metric': 'Total Requests Analyzed', 'value': format('{{:,}}', total_requests)}},
  {{'ord': 2, 'metric': 'Blocked Requests', 'value': format('{{:,}}', blocked_requests)}},
  {{'ord': 3, 'metric': 'Block Rate', 'value': printf('%.2f', block_rate_percent) || '%'}},
  {{'ord': 4, 'metric': 'Unique Client IPs', 'value': format('{{:,}}', unique_client_ips)}},
  {{'ord': 5, 'metric': 'Unique Countries', 'value': format('{{:,}}', unique_countries)}},
  {{'ord': 6, 'metric': 'Web ACLs Configured', 'value': CAST(total_web_acls AS VARCHAR)}},
  {{'ord': 7, 'metric': 'Protected Resources', 'value': CAST(total_protected_resources AS VARCHAR)}},
  {{'ord': 8, 'metric': 'Logging Coverage', 'value': CAST(h // 10 AS VARCHAR) || '.' || CAST(h % 10 AS VARCHAR) || '%'}}
], recursive := true) FROM (SELECT *, (CAST(round({pct2_sql('web_acls_with_logging', 'total_web_acls')} * 100) AS BIGINT) + 5) // 10 AS h
  FROM ({summary_sql('v_logs')}), ({COVERAGE})))""")
def executive_kpis(s, d):
    return cl.executive_kpis(v.logs(s, d), v.acls(s, d), v.logging(s, d), v.resources(s, d))


UNUSED = """SELECT web_acl_id, name, rule_type, priority FROM v_rules r WHERE NOT EXISTS (
  SELECT 1 FROM v_logs l WHERE l.web_acl_id = r.web_acl_id AND l.terminating_rule_id = r.name)"""


@query("rule_review_flags", f"""
SELECT 'rule' AS kind, rule_id AS subject, rule_type AS detail,
  CASE WHEN block_rate_percent < 1 THEN 'low_performing' WHEN block_rate_percent < 5 THEN 'below_five_percent' ELSE 'high' END AS flag
FROM ({RULES}) WHERE block_rate_percent < 5 OR block_rate_percent > 80
UNION ALL SELECT 'country', country, NULL, 'high_risk' FROM ({geo_sql('v_logs')}) WHERE threat_score > 75
UNION ALL SELECT 'rule', name, web_acl_id, 'unused' FROM ({UNUSED})""")
def rule_review_flags(s, d):
    logs = v.logs(s, d)
    return cl.rule_review_flags(logs, inventory.unused_rules(v.rules(s, d), logs))


@query("chart_series", f"""
SELECT 'action_pie' AS chart, action AS label, 'count' AS series, count AS value FROM ({actions_sql('v_logs')})
UNION ALL SELECT 'daily_lines', CAST(date AS VARCHAR), unnest(['total', 'blocked', 'allowed']), unnest([total_requests, blocked, allowed]) FROM ({daily_sql('v_logs')})
UNION ALL SELECT 'geo_bars', country, 'blocked', blocked_requests FROM ({COUNTRY_BLOCKS} ORDER BY blocked_requests DESC, country LIMIT 15)
UNION ALL SELECT 'attack_bars', attack_type, 'count', count FROM ({attacks_sql('v_logs')})
UNION ALL SELECT 'hourly_bars', CAST(hour AS VARCHAR), unnest(['total', 'blocked']), unnest([total_requests, blocked]) FROM ({hourly_sql('v_logs')})
UNION ALL SELECT 'rule_bars', rule_id, unnest(['hits', 'blocks']), unnest([hits, blocks]) FROM (SELECT rule_id, CAST(sum(hit_count) AS BIGINT) AS hits,
  CAST(sum(blocks) AS BIGINT) AS blocks FROM ({RULES}) GROUP BY 1 ORDER BY hits DESC, rule_id LIMIT 15)""")
def chart_series(s, d):
    return reports.chart_series(v.logs(s, d))


# calendars
HOUR_COUNTS = f"SELECT date_trunc('hour', timestamp) AS hour, {N} AS n, {n_sql(BLOCK)} AS b FROM v_logs GROUP BY 1"


@query("hour_spine", """SELECT CAST(unnest(generate_series(date_trunc('hour', a), date_trunc('hour', z), INTERVAL 1 HOUR)) AS TIMESTAMP) AS bucket
FROM (SELECT min(ts) AS a, max(ts) AS z FROM events)""")
def hour_spine(s, d):
    ends = v.table(s, d, "events").agg(F.min("ts").cast("timestamp").alias("a"), F.max("ts").cast("timestamp").alias("z"))
    return times.calendar(ends, "a", "z", "hour", "bucket").select("bucket")


@query("day_spine", """SELECT CAST(unnest(generate_series(date_trunc('day', a), date_trunc('day', z), INTERVAL 1 DAY)) AS TIMESTAMP) AS bucket
FROM (SELECT min(o_orderdate) AS a, max(o_orderdate) AS z FROM orders)""")
def day_spine(s, d):
    ends = v.table(s, d, "orders").agg(F.min("o_orderdate").cast("timestamp").alias("a"), F.max("o_orderdate").cast("timestamp").alias("z"))
    return times.calendar(ends, "a", "z", "day", "bucket").select("bucket")


@query("filled_hourly", f"""
SELECT hour, coalesce(n, 0) AS total_requests, coalesce(b, 0) AS blocked
FROM (SELECT CAST(unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS TIMESTAMP) AS hour FROM ({HOUR_COUNTS})) LEFT JOIN ({HOUR_COUNTS}) USING (hour)""")
def filled_hourly(s, d):
    return metrics.hourly_filled(v.logs(s, d))


@query("day_count", """SELECT web_acl_id, CAST(floor((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400000000) AS BIGINT) AS days FROM v_logs GROUP BY 1""")
def day_count(s, d):
    return v.logs(s, d).groupBy("web_acl_id").agg(times.elapsed_days(F.min("timestamp"), F.max("timestamp")).alias("days"))


@query("threat_rate_unrounded", f"SELECT country, blocked_requests / total_requests * 100.0 AS rate FROM ({geo_sql('v_logs')})")
def threat_rate_unrounded(s, d):
    geo = metrics.geo_distribution(v.logs(s, d))
    return geo.select("country", share("blocked_requests", "total_requests").alias("rate"))
