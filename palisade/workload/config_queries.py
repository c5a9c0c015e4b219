"""Configuration tables: labels, upserts, joins, counts and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arns, labels
from ..operators import append, costs, inventory, metrics, quality, store, upsert
from ..session import scratch_path
from ..sources import config, tables
from . import views as v
from .registry import pct2_sql, query

N = "CAST(count(*) AS BIGINT)"


# labels
@query("rule_type", "SELECT rule_id, rule_type FROM v_rules")
def rule_type(s, d):
    return v.rules(s, d).select("rule_id", labels.rule_type("statement").alias("rule_type"))


def acl_dump(s, d):
    """Every ACL as one JSON dump with the rules of its parts, and back. One dump
    holds the rules of one ACL, a number the ACL service itself limits; here one
    rule per dump keeps that independent of the data."""
    rules = v.rules(s, d)
    escaped = F.when(F.col("action").isin("", "{bad"), F.lit("{}")).otherwise(F.col("action"))
    text = F.concat(
        F.lit('{"Id":"'), F.col("web_acl_id"), F.lit('","Name":"n","Capacity":5,"DefaultAction":{"Allow":{}},"Rules":[{"Name":"'), F.col("name"),
        F.lit('","Priority":'), F.col("priority").cast("string"), F.lit(',"Action":'), escaped,
        F.lit(',"Statement":'), F.col("statement"), F.lit(',"VisibilityConfig":{"MetricName":"m"}}]}'),
    )
    return rules.select(text.alias("value"))


@query("extract_rules", """SELECT web_acl_id, 0 AS position, name, priority, rule_type,
  CASE WHEN action IN ('', '{bad') THEN '{}' ELSE action END AS action,
  CASE WHEN rule_type = 'MANAGED_RULE_GROUP' THEN 'Vendor-' || CAST(p_partkey % 3 AS VARCHAR) END AS vendor_name,
  CASE WHEN rule_type = 'MANAGED_RULE_GROUP' THEN p_brand END AS group_name,
  CASE WHEN rule_type = 'MANAGED_RULE_GROUP' THEN CAST(p_size AS VARCHAR) END AS group_version FROM v_rules""")
def extract_rules(s, d):
    read = config.read_acl_text(acl_dump(s, d), F.lit("REGIONAL"))
    return config.extract_rules(read).select(
        "web_acl_id", "position", "name", "priority", "rule_type", "action", "vendor_name", "group_name", "group_version"
    )


@query("scan_acl_config", """SELECT web_acl_id, 'n' AS name, CAST(5 AS BIGINT) AS capacity, '{"Allow":{}}' AS default_action, 'REGIONAL' AS scope, CAST(count(*) AS BIGINT) AS dumps
FROM v_rules GROUP BY 1""")
def scan_acl_config(s, d):
    from ..operators.sinks import write_raw

    path = scratch_path(s, "acl-dumps")
    write_raw(acl_dump(s, d), path)
    rows = upsert.acl_rows(config.scan_acl_config(s, path, "REGIONAL"))
    return rows.groupBy("web_acl_id", "name", "capacity", "default_action", "scope").agg(metrics.n_rows().alias("dumps"))


@query("default_action_label", "SELECT web_acl_id, default_label AS default_action FROM v_acls")
def default_action_label(s, d):
    return v.acls(s, d).select("web_acl_id", labels.default_action_label("default_action").alias("default_action"))


ACTION_LABEL = """CASE action WHEN '{"Allow":{}}' THEN 'ALLOW' WHEN '{"Block":{}}' THEN 'BLOCK' WHEN '{"Count":{}}' THEN 'COUNT'
  WHEN '{"Captcha":{}}' THEN 'CAPTCHA' WHEN '{}' THEN %s WHEN '' THEN %s ELSE %s END"""
COUNTED = ACTION_LABEL % ("'OTHER'", "NULL", "'UNKNOWN'")
LISTED = ACTION_LABEL % ("action", "action", "action")


@query("rule_action_label", f"SELECT rule_id, {COUNTED} AS counted, {LISTED} AS listed FROM v_rules")
def rule_action_label(s, d):
    return v.rules(s, d).select(
        "rule_id", labels.rule_action_label("action").alias("counted"), labels.rule_action_detail("action").alias("listed")
    )


@query("parse_arn", """SELECT resource_arn, 'arn' AS arn, 'aws' AS partition, string_split(resource_arn, ':')[3] AS service, 'us-east-1' AS region,
  '123456789012' AS account_id, array_to_string(string_split(resource_arn, ':')[6:], ':') AS resource FROM v_resources""")
def parse_arn(s, d):
    return v.resources(s, d).select("resource_arn", arns.parse_arn("resource_arn").alias("p")).select("resource_arn", "p.*")


@query("resource_type", "SELECT resource_arn, resource_type FROM v_resources")
def resource_type(s, d):
    return v.resources(s, d).select("resource_arn", arns.resource_type("resource_arn").alias("resource_type"))


SHORT = "CASE WHEN contains(resource_arn, '/') THEN split_part(resource_arn, '/', -1) ELSE split_part(resource_arn, ':', -1) END"


@query("resource_short_name", f"SELECT resource_arn, {SHORT} AS short_name FROM v_resources")
def resource_short_name(s, d):
    return v.resources(s, d).select("resource_arn", arns.resource_short_name("resource_arn").alias("short_name"))


@query("destination_type", "SELECT config_id, destination_type FROM v_logging")
def destination_type(s, d):
    return v.logging(s, d).select("config_id", arns.destination_type("destination_arn").alias("destination_type"))


@query("parse_log_group_arn", "SELECT web_acl_id, 'us-east-1' AS region, 'aws-waf-logs-' || substr(web_acl_id, 5) AS log_group FROM v_logging WHERE destination_type = 'CLOUDWATCH'")
def parse_log_group_arn(s, d):
    found = v.logging(s, d).select("web_acl_id", arns.log_group("destination_arn").alias("g"))
    return found.where(F.col("g").isNotNull()).select("web_acl_id", "g.region", "g.log_group")


@query("parse_bucket_arn", """SELECT config_id, split_part(replace(destination_arn, 'arn:aws:s3:::', ''), '/', 1) AS bucket,
  CASE WHEN contains(destination_arn, '/') THEN 'AWSLogs/' || substr(web_acl_id, 5) ELSE '' END AS prefix FROM v_logging WHERE destination_type = 'S3'""")
def parse_bucket_arn(s, d):
    stores = v.logging(s, d).where(F.col("destination_type") == "S3")
    return stores.select("config_id", arns.bucket("destination_arn").alias("b")).select("config_id", "b.bucket", "b.prefix")


# upserts: a dump is stored, then one with changed, new and repeated rows is merged into it
def loaded(version: int):
    """The moment at which a dump is loaded."""
    return F.timestamp_seconds(F.lit(1000 * version))


LOADED = "to_timestamp(CASE WHEN {second} THEN 2000 ELSE 1000 END)::TIMESTAMP"


def stored(s, table: str, *batches) -> DataFrame:
    """The stored table after the batches, each a version of its own."""
    path, (key, kept) = scratch_path(s, table), upsert.TABLES[table]
    for rows in batches:
        store.merge(rows, path, key, keep_first=kept, within=[c for c in upsert.ORDER if c in rows.columns])
    return store.read(s, path)


@query("upsert_web_acls", f"""SELECT web_acl_id, name, scope, default_action, CASE WHEN again THEN 'again' ELSE '' END AS description, '{{}}' AS visibility_config,
  capacity + CASE WHEN again THEN 2 WHEN second THEN 1 ELSE 0 END AS capacity, k % 7 = 0 AS managed_by_firewall_manager,
  {LOADED.format(second="k % 5 = 0")} AS created_at, {LOADED.format(second="second")} AS updated_at
FROM (SELECT *, second AND k % 3 = 0 AS again FROM (SELECT *, k % 5 = 0 OR capacity > 2000 AS second FROM (SELECT *, CAST(substr(web_acl_id, 5) AS BIGINT) AS k FROM v_acls)))""")
def upsert_web_acls(s, d):
    k = F.substring("web_acl_id", 5, 20).cast("bigint")

    def dump(rows, more, description, position):
        text = F.concat(
            F.lit('{"Id":"'), F.col("web_acl_id"), F.lit('","Name":"'), F.col("name"), F.lit('","Capacity":'), (F.col("capacity") + more).cast("string"),
            F.lit(',"DefaultAction":'), F.when(F.col("default_action") == "NONE", '"NONE"').otherwise(F.col("default_action")), F.lit(description),
            F.when(k % 7 == 0, ',"ManagedByFirewallManager":true').otherwise(""), F.lit("}"),
        )
        texts = rows.select(text.alias("value"), "scope", F.lit(position).alias("position"))
        return config.read_acl_text(texts, F.col("scope"), "position")

    acls = v.acls(s, d)
    second = acls.where((k % 5 == 0) | (F.col("capacity") > 2000))
    changed = dump(second, 1, "", 0).unionByName(dump(second.where(k % 3 == 0), 2, ',"Description":"again"', 1))
    return stored(s, "web_acls", upsert.acl_rows(dump(acls.where(k % 5 != 0), 0, "", 0), loaded(1)), upsert.acl_rows(changed, loaded(2)))


@query("upsert_rules", f"""SELECT web_acl_id || '_' || CASE WHEN p_partkey % 7 = 0 THEN 'unknown' ELSE name END AS rule_id, web_acl_id, arg_max(CASE WHEN p_partkey % 7 = 0 THEN '' ELSE name END, o) AS name,
  arg_max(priority + CASE WHEN second THEN 1000 ELSE 0 END, o) AS priority, arg_max(rule_type, o) AS rule_type, arg_max(CASE WHEN action IN ('', '{{bad') THEN '{{}}' ELSE action END, o) AS action,
  '{{"MetricName":"m"}}' AS visibility_config, arg_max(statement, o) AS statement, {LOADED.format(second="bool_or(second)")} AS created_at
FROM (SELECT *, p_partkey + CASE WHEN second THEN 1000000000000 ELSE 0 END AS o FROM (SELECT *, p_partkey % 2 = 0 OR p_partkey % 6 = 1 AS second FROM v_rules)) GROUP BY 1, 2""")
def upsert_rules(s, d):
    """Every dump lists its rule twice, the last with another priority; nameless rules of
    one ACL share a key, and the later dump counts."""
    k = F.col("position")
    escaped = F.when(F.col("action").isin("", "{bad"), F.lit("{}")).otherwise(F.col("action"))

    def dump(rows, more):
        name = F.when(k % 7 != 0, F.concat(F.lit('"Name":"'), F.col("name"), F.lit('",'))).otherwise("")
        rule = lambda priority: F.concat(
            F.lit("{"), name, F.lit('"Priority":'), priority.cast("string"), F.lit(',"Action":'), escaped, F.lit(',"Statement":'), F.col("statement"),
            F.lit(',"VisibilityConfig":{"MetricName":"m"}}'))
        rules = F.concat(rule(F.lit(7)), F.lit(","), rule(F.col("priority") + more))
        text = F.concat(F.lit('{"Id":"'), F.col("web_acl_id"), F.lit('","Rules":['), rules, F.lit("]}"))
        texts = rows.select(text.alias("value"), k.alias("dump"))
        return config.extract_rules(config.read_acl_text(texts, F.lit("REGIONAL"), "dump"), "dump")

    rules = v.rules(s, d)
    first, second = rules.where(k % 6 != 1), rules.where((k % 2 == 0) | (k % 6 == 1))
    return stored(s, "rules", upsert.rule_rows(dump(first, 0), loaded(1)), upsert.rule_rows(dump(second, 1000), loaded(2)))


@query("upsert_resources", f"""SELECT association_id, web_acl_id, resource_arn, CASE WHEN c_custkey % 3 = 0 THEN 'LB' ELSE resource_type END AS resource_type,
  {LOADED.format(second="c_custkey % 3 = 0 OR c_custkey % 4 = 0")} AS created_at FROM v_resources""")
def upsert_resources(s, d):
    rows = v.resources(s, d).withColumns({"k": F.regexp_extract("resource_arn", "([0-9]+)$", 1).cast("bigint"), "position": F.lit(0)})
    k = F.col("k")
    second = rows.where((k % 3 == 0) | (k % 4 == 0))
    repeated = second.unionByName(second.where(k % 3 == 0).withColumns({"resource_type": F.lit("LB"), "position": F.lit(1)}))
    return stored(s, "resource_associations", upsert.resource_rows(rows.where(k % 4 != 0), loaded(1)), upsert.resource_rows(repeated, loaded(2)))


REDACTED = '[{"SingleHeader":{"Name":"cookie"}}]'


@query("upsert_logging", f"""SELECT config_id, web_acl_id, destination_type, destination_arn, CASE WHEN second THEN 'TEXT' ELSE log_format END AS log_format, sampling_rate,
  CASE WHEN second THEN '{REDACTED}' ELSE '[]' END AS redacted_fields, {LOADED.format(second="second")} AS created_at
FROM (SELECT *, k % 2 = 0 OR k % 5 = 0 AS second FROM (SELECT *, CAST(substr(web_acl_id, 5) AS BIGINT) AS k FROM v_logging))""")
def upsert_logging(s, d):
    k = F.substring("web_acl_id", 5, 20).cast("bigint")
    dump = v.logging_dump(s, d)
    second = dump.where((k % 2 == 0) | (k % 5 == 0)).withColumns({"log_format": F.lit("TEXT"), "redacted_fields": F.lit(REDACTED)})
    return stored(s, "logging_configurations", upsert.logging_rows(dump.where(k % 5 != 0), loaded(1)), upsert.logging_rows(second.unionByName(second), loaded(2)))


@query("table_stats", " UNION ALL ".join(f"SELECT '{n}' AS table_name, {N} AS row_count FROM {t}" for n, t in
       [("web_acls", "v_acls"), ("rules", "v_rules"), ("resource_associations", "v_resources"), ("logging_configurations", "v_logging"), ("waf_logs", "v_logs")]))
def table_stats(s, d):
    return append.table_stats({
        "web_acls": v.acls(s, d), "rules": v.rules(s, d), "resource_associations": v.resources(s, d),
        "logging_configurations": v.logging(s, d), "waf_logs": v.logs(s, d),
    })


@query("key_checks", """
SELECT 'web_acls.web_acl_id unique' AS "check", (SELECT count(*) FROM (SELECT 1 FROM v_acls GROUP BY web_acl_id HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'rules.rule_id unique', (SELECT count(*) FROM (SELECT 1 FROM v_rules GROUP BY rule_id HAVING count(*) > 1))
UNION ALL SELECT 'waf_logs.uri unique', (SELECT count(*) FROM (SELECT 1 FROM v_logs GROUP BY uri HAVING count(*) > 1))
UNION ALL SELECT 'rules.web_acl_id known', (SELECT count(*) FROM v_rules WHERE web_acl_id NOT IN (SELECT web_acl_id FROM v_acls))
UNION ALL SELECT 'resources.web_acl_id known', (SELECT count(*) FROM v_resources WHERE web_acl_id NOT IN (SELECT web_acl_id FROM v_acls))
UNION ALL SELECT 'waf_logs.web_acl_id known', (SELECT count(*) FROM v_logs WHERE web_acl_id NOT IN (SELECT web_acl_id FROM v_acls))""")
def key_checks(s, d):
    acls = v.acls(s, d)
    return quality.key_report(
        {"web_acls": (acls, "web_acl_id"), "rules": (v.rules(s, d), "rule_id"), "waf_logs": (v.logs(s, d), "uri")},
        {"rules": (v.rules(s, d), acls, "web_acl_id"), "resources": (v.resources(s, d), acls, "web_acl_id"), "waf_logs": (v.logs(s, d), acls, "web_acl_id")},
    )


# joins
@query("log_groups_by_acl", """SELECT 'aws-waf-logs-' || substr(l.web_acl_id, 5) AS log_group, name AS web_acl_name, l.web_acl_id, 'us-east-1' AS region
FROM v_logging l JOIN v_acls a ON l.web_acl_id = a.web_acl_id WHERE destination_type = 'CLOUDWATCH'""")
def log_groups_by_acl(s, d):
    return inventory.log_groups_by_acl(v.acls(s, d), v.logging(s, d)).orderBy("web_acl_name")


@query("resources_named", "SELECT association_id, resource_type, coalesce(name, 'Unknown') AS web_acl_name FROM v_resources r LEFT JOIN v_acls a ON r.web_acl_id = a.web_acl_id")
def resources_named(s, d):
    return inventory.resources_named(v.resources(s, d), v.acls(s, d)).select("association_id", "resource_type", "web_acl_name")


COUNTS = """(SELECT web_acl_id, count(*) AS rules_count FROM v_rules GROUP BY 1) r USING (web_acl_id)
  LEFT JOIN (SELECT web_acl_id, count(*) AS resources_count FROM v_resources GROUP BY 1) c USING (web_acl_id)"""


@query("acl_inventory", f"""SELECT name, web_acl_id, scope, default_label AS default_action, capacity, coalesce(rules_count, 0) AS rules_count,
  coalesce(resources_count, 0) AS resources_count, CASE WHEN web_acl_id IN (SELECT web_acl_id FROM v_logging) THEN 'Yes' ELSE 'No' END AS logging
FROM v_acls LEFT JOIN {COUNTS}""")
def acl_inventory(s, d):
    return inventory.acl_inventory(v.acls(s, d), v.rules(s, d), v.resources(s, d), v.logging(s, d))


@query("rules_named", f"SELECT coalesce(a.name, r.web_acl_id) AS web_acl_name, r.name, priority, rule_type, {LISTED} AS action FROM v_rules r LEFT JOIN v_acls a ON r.web_acl_id = a.web_acl_id")
def rules_named(s, d):
    return inventory.rules_named(v.rules(s, d), v.acls(s, d)).orderBy("web_acl_name", "priority")


@query("acl_summary", f"""SELECT web_acl_id, name, scope, capacity, coalesce(rules_count, 0) AS rules_count, coalesce(resources_count, 0) AS resources_count,
  coalesce(texts, 'None') AS resources, greatest(coalesce(resources_count, 0) - 3, 0) AS more_resources, coalesce(kind, 'Not configured') AS logging
FROM v_acls LEFT JOIN {COUNTS}
LEFT JOIN (SELECT web_acl_id, string_agg(resource_type || ': ' || {SHORT}, '; ' ORDER BY position) AS texts
  FROM (SELECT *, row_number() OVER (PARTITION BY web_acl_id ORDER BY resource_arn) AS position FROM v_resources) WHERE position <= 3 GROUP BY 1) t USING (web_acl_id)
LEFT JOIN (SELECT web_acl_id, min(destination_type) AS kind FROM v_logging GROUP BY 1) k USING (web_acl_id)""")
def acl_summary(s, d):
    return inventory.acl_summary(v.acls(s, d), v.rules(s, d), v.resources(s, d), v.logging(s, d))


@query("acl_rule_list", """SELECT a.web_acl_id, a.name, coalesce(n, 0) AS rules_count, position, r.name AS rule_name, rule_type, priority
FROM v_acls a LEFT JOIN (SELECT *, CAST(row_number() OVER (PARTITION BY web_acl_id ORDER BY priority, name, rule_id) AS BIGINT) AS position,
  count(*) OVER (PARTITION BY web_acl_id) AS n FROM v_rules) r ON a.web_acl_id = r.web_acl_id""")
def acl_rule_list(s, d):
    return inventory.acl_rule_list(v.acls(s, d), v.rules(s, d))


@query("resources_by_acl", """SELECT coalesce(name, 'Unknown') AS web_acl_name, resource_arn, resource_type,
  CAST(row_number() OVER (PARTITION BY coalesce(name, 'Unknown') ORDER BY resource_arn, association_id) AS BIGINT) AS position
FROM v_resources r LEFT JOIN v_acls a ON r.web_acl_id = a.web_acl_id""")
def resources_by_acl(s, d):
    return inventory.resources_by_acl(v.resources(s, d), v.acls(s, d))


@query("acls_with_logging", "SELECT web_acl_id, name FROM v_acls WHERE web_acl_id IN (SELECT web_acl_id FROM v_logging)")
def acls_with_logging(s, d):
    return inventory.acls_with_logging(v.acls(s, d), v.logging(s, d)).select("web_acl_id", "name")


@query("with_total", f"""SELECT terminating_rule_id, count, total, {pct2_sql('count', 'total')} AS percentage FROM
(SELECT terminating_rule_id, {N} AS count FROM v_logs WHERE terminating_rule_id IS NOT NULL GROUP BY 1), (SELECT {N} AS total FROM v_logs)""")
def with_total(s, d):
    from ..functions.numbers import pct2

    logs = v.logs(s, d)
    counts = logs.groupBy("terminating_rule_id").agg(metrics.n_rows().alias("count")).withColumn("total", metrics.of_all("count"))
    return counts.where(F.col("terminating_rule_id").isNotNull()).withColumn("percentage", pct2("count", "total"))


@query("logs_with_acl", "SELECT log_id, l.web_acl_id, name AS acl_name, scope AS acl_scope, action FROM v_logs l JOIN v_acls a ON l.web_acl_id = a.web_acl_id")
def logs_with_acl(s, d):
    return inventory.logs_with_acl(v.logs(s, d), v.acls(s, d)).select("log_id", "web_acl_id", "acl_name", "acl_scope", "action")


@query("traffic_per_acl", f"""SELECT l.web_acl_id, name AS acl_name, scope AS acl_scope, {N} AS total_requests, CAST(count(CASE WHEN action = 'BLOCK' THEN 1 END) AS BIGINT) AS blocked_requests
FROM v_traffic l JOIN v_acls a ON l.web_acl_id = a.web_acl_id GROUP BY 1, 2, 3""")
def traffic_per_acl(s, d):
    return inventory.traffic_per_acl(v.traffic(s, d), v.acls(s, d))


@query("unused_rules", """SELECT web_acl_id, name, rule_type, priority FROM v_rules r WHERE NOT EXISTS (
  SELECT 1 FROM v_logs l WHERE l.web_acl_id = r.web_acl_id AND l.terminating_rule_id = r.name)""")
def unused_rules(s, d):
    return inventory.unused_rules(v.rules(s, d), v.logs(s, d))


@query("acl_complete", """SELECT a.web_acl_id, name, coalesce(n, 0) AS resource_count, a.web_acl_id IN (SELECT web_acl_id FROM v_logging) AS logging_enabled,
  resource_arn, resource_type, string_split(resource_arn, ':')[3] AS service, string_split(resource_arn, ':')[4] AS region, string_split(resource_arn, ':')[5] AS account_id,
  array_to_string(string_split(resource_arn, ':')[6:], ':') AS resource
FROM v_acls a LEFT JOIN v_resources r ON a.web_acl_id = r.web_acl_id LEFT JOIN (SELECT web_acl_id, count(*) AS n FROM v_resources GROUP BY 1) c ON a.web_acl_id = c.web_acl_id""")
def acl_complete(s, d):
    return inventory.acl_complete(v.acls(s, d), v.resources(s, d), v.logging(s, d))


# counts
@query("acl_complexity", """SELECT web_acl_id, coalesce(n, 0) AS total_rules, capacity AS capacity_used, coalesce(m, 0) AS managed_rule_groups, coalesce(t, 0) AS rule_type_count,
  coalesce(rate, false) AS has_rate_limiting, coalesce(geo, false) AS has_geo_blocking, coalesce(ip, false) AS has_ip_filtering, default_label AS default_action
FROM v_acls LEFT JOIN (SELECT web_acl_id, count(*) AS n, count(CASE WHEN rule_type = 'MANAGED_RULE_GROUP' THEN 1 END) AS m, count(DISTINCT rule_type) AS t,
  bool_or(rule_type = 'RATE_BASED') AS rate, bool_or(rule_type = 'GEO_MATCH') AS geo, bool_or(rule_type = 'IP_SET') AS ip FROM v_rules GROUP BY 1) USING (web_acl_id)""")
def acl_complexity(s, d):
    return inventory.acl_complexity(v.acls(s, d), v.rules(s, d))


@query("acl_rule_types", f"SELECT web_acl_id, rule_type, {N} AS count FROM v_rules GROUP BY 1, 2")
def acl_rule_types(s, d):
    return inventory.rule_type_histogram(v.rules(s, d))


@query("rules_by_type", f"SELECT rule_type, count, {pct2_sql('count', 'total')} AS percentage FROM (SELECT rule_type, {N} AS count FROM v_rules GROUP BY 1), (SELECT count(*) AS total FROM v_rules)")
def rules_by_type(s, d):
    return inventory.rules_by_type(v.rules(s, d))


@query("rules_by_action", f"""SELECT rule_action, count, {pct2_sql('count', 'total')} AS percentage
FROM (SELECT {COUNTED} AS rule_action, {N} AS count FROM v_rules GROUP BY 1), (SELECT count(*) AS total FROM v_rules) WHERE rule_action IS NOT NULL""")
def rules_by_action(s, d):
    return inventory.rules_by_action(v.rules(s, d))


@query("cost_metrics", """SELECT (SELECT count(*) FROM v_rules) AS total_rules, (SELECT count(*) FROM v_rules WHERE rule_type LIKE '%MANAGED%') AS managed_rule_groups,
  (SELECT CAST(coalesce(sum(capacity), 0) AS BIGINT) FROM v_acls) AS estimated_capacity_wcu, (SELECT count(*) FROM v_logging) AS logging_enabled_web_acls""")
def cost_metrics(s, d):
    return inventory.cost_metrics(v.acls(s, d), v.rules(s, d), v.logging(s, d))


@query("managed_rules", "SELECT web_acl_id, name AS rule FROM v_rules WHERE rule_type LIKE '%MANAGED%'")
def managed_rules(s, d):
    return inventory.managed_rules(v.rules(s, d))


# sorting and sets
@query("acls_sorted", "SELECT web_acl_id, name, scope FROM v_acls ORDER BY scope, name")
def acls_sorted(s, d):
    return inventory.acls_sorted(v.acls(s, d)).select("web_acl_id", "name", "scope")


@query("union_scopes", "SELECT web_acl_id, name, scope FROM v_acls")
def union_scopes(s, d):
    acls = v.acls(s, d).withColumn("version", F.lit(1))
    both = acls.where(F.col("scope") == "REGIONAL").unionByName(acls.where(F.col("scope") == "CLOUDFRONT"))
    return upsert.upsert(None, both, "web_acl_id", ["version"]).select("web_acl_id", "name", "scope")


@query("union_sources", f"""SELECT source_name, {N} AS rows, count(log_id) AS with_id, count(uri) AS with_uri FROM (
  SELECT 'stream' AS source_name, log_id, uri FROM v_logs UNION ALL SELECT 'files', NULL, NULL FROM v_traffic) GROUP BY 1""")
def union_sources(s, d):
    both = tables.union_sources({"stream": v.logs(s, d), "files": v.traffic(s, d)})
    return both.groupBy("source_name").agg(metrics.n_rows().alias("rows"), F.count("log_id").alias("with_id"), F.count("uri").alias("with_uri"))


@query("group_rows", """SELECT web_acl_id, log_id, CAST(row_number() OVER (PARTITION BY web_acl_id ORDER BY timestamp, log_id) AS BIGINT) AS position FROM v_logs""")
def group_rows(s, d):
    from ..operators.ordering import number_rows

    rows = v.logs(s, d).select("web_acl_id", "timestamp", "log_id")
    return number_rows(rows, ["timestamp", "log_id"], "position", ["web_acl_id"]).drop("timestamp")


@query("scan_table", """SELECT 'web_acls' AS name, count(*) AS rows FROM v_acls WHERE web_acl_id IN ('acl-1', 'acl-2')
UNION ALL SELECT 'rules', count(*) FROM v_rules WHERE web_acl_id IN ('acl-1', 'acl-2') UNION ALL SELECT 'resources', count(*) FROM v_resources WHERE web_acl_id IN ('acl-1', 'acl-2')
UNION ALL SELECT 'logging', count(*) FROM v_logging""")
def scan_table(s, d):
    ids = ["acl-1", "acl-2"]
    parts = {
        "web_acls": tables.scan_table(v.acls(s, d), ids), "rules": tables.scan_table(v.rules(s, d), ids),
        "resources": tables.scan_table(v.resources(s, d), ids), "logging": tables.scan_table(v.logging(s, d)),
    }
    return append.table_stats(parts).select(F.col("table_name").alias("name"), F.col("row_count").alias("rows"))


@query("run_sql", f"SELECT country, {N} AS n FROM v_logs WHERE action = 'BLOCK' AND http_status = 403 GROUP BY country")
def run_sql(s, d):
    text = "SELECT country, count(*) AS n FROM waf_logs WHERE action = ? AND http_status = ? GROUP BY country"
    return tables.run_sql(s, text, {"waf_logs": v.logs(s, d)}, ["BLOCK", 403])


# model prices: one per part brand and size, a default for models without one
USAGE_SQL = """SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'bedrock' ELSE 'openai' END AS provider, CASE WHEN o_orderkey % 5 = 0 THEN 'retired' ELSE 'model-' || CAST(o_custkey AS VARCHAR) END AS model,
  o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS input_tokens, o_orderkey % 5000 AS output_tokens FROM orders"""
PRICES_SQL = "SELECT provider, 'model-' || CAST(c_custkey AS VARCHAR) AS model, c_nationkey / 4.0 AS input_price, c_nationkey / 2.0 AS output_price FROM customer, (VALUES ('bedrock'), ('openai')) t(provider)"


@query("llm_cost", f"""SELECT o_orderkey, input_tokens / 1000000.0::DOUBLE * coalesce(input_price::DOUBLE, CASE provider WHEN 'bedrock' THEN 3.0 ELSE 1.0 END::DOUBLE)
  + output_tokens / 1000000.0::DOUBLE * coalesce(output_price::DOUBLE, CASE provider WHEN 'bedrock' THEN 15.0 ELSE 3.0 END::DOUBLE) AS cost
FROM ({USAGE_SQL}) LEFT JOIN ({PRICES_SQL}) USING (provider, model)""")
def llm_cost(s, d):
    o, c = v.table(s, d, "orders"), v.table(s, d, "customer")
    usage = o.select(
        F.when(F.col("o_orderkey") % 2 == 0, "bedrock").otherwise("openai").alias("provider"),
        F.when(F.col("o_orderkey") % 5 == 0, "retired").otherwise(F.concat(F.lit("model-"), F.col("o_custkey").cast("string"))).alias("model"),
        "o_orderkey", F.floor("o_totalprice").cast("bigint").alias("input_tokens"), (F.col("o_orderkey") % 5000).alias("output_tokens"),
    )
    prices = c.select(
        F.explode(F.array(F.lit("bedrock"), F.lit("openai"))).alias("provider"),
        F.concat(F.lit("model-"), F.col("c_custkey").cast("string")).alias("model"),
        (F.col("c_nationkey") / 4.0).alias("input_price"), (F.col("c_nationkey") / 2.0).alias("output_price"),
    )
    return costs.model_costs(usage, prices).select("o_orderkey", "cost")


# configuration sources
@query("scan_resources_by_type", """SELECT web_acl_id, resource_arn, resource_type FROM v_resources r JOIN v_acls a USING (web_acl_id)
WHERE (scope = 'CLOUDFRONT' AND resource_type = 'CLOUDFRONT') OR (scope = 'REGIONAL' AND resource_type IN ('ALB', 'API_GATEWAY', 'UNKNOWN'))""")
def scan_resources_by_type(s, d):
    kind = F.col("resource_type")
    listed = F.when(kind == "ALB", "APPLICATION_LOAD_BALANCER").when(kind == "UNKNOWN", "APPSYNC").otherwise(kind)
    scoped = v.resources(s, d).join(v.acls(s, d).select("web_acl_id", "scope"), "web_acl_id")
    out = None
    for scope in ("REGIONAL", "CLOUDFRONT"):
        dump = scoped.where(F.col("scope") == scope).select(F.col("web_acl_id").alias("WebAclId"), listed.alias("ResourceType"), F.array("resource_arn").alias("ResourceArns"))
        found = config.resources_of_scope(dump, F.lit(scope)).select("web_acl_id", "resource_arn", "resource_type")
        out = found if out is None else out.unionByName(found)
    return out


@query("discover_log_sources", """SELECT web_acl_id, name, scope, destination_arn, source_type,
  CASE WHEN source_type = 's3' THEN split_part(split_part(destination_arn, ':', 6), '/', 1) END AS bucket,
  CASE WHEN source_type = 'cloudwatchlogs' THEN split_part(destination_arn, ':', 7) END AS log_group,
  CASE WHEN source_type = '' THEN 'unsupported source type' END AS reject_reason
FROM (SELECT *, CASE WHEN contains(destination_arn, ':s3:') THEN 's3' WHEN contains(destination_arn, ':logs:') THEN 'cloudwatchlogs' ELSE '' END AS source_type
  FROM (SELECT web_acl_id, destinations[1] AS destination_arn FROM v_dump) JOIN v_acls USING (web_acl_id) WHERE destination_arn IS NOT NULL)""")
def discover_log_sources(s, d):
    return config.discover_log_sources(v.acls(s, d), v.logging_dump(s, d))
