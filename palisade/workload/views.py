"""The driver's tables seen as logs and configuration.

Each view exists twice: as a DataFrame, and as SQL for the comparison. All rows
of the underlying table are used. The number of ACLs is the number of suppliers,
so rules and resources per ACL stay the same at every scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arns, labels
from ..operators import upsert

# Rule names seen in the logs, by number; the one after the last is null.
RULE_NAMES = [
    "AWS-AWSManagedRulesSQLiRuleSet", "Custom-XSS-Block", "ScannerProbe",
    "AWS-AWSManagedRulesBotControlRuleSet", "GeoBlock-Embargo", "RateLimit-Login",
    "AWS-AWSManagedRulesAmazonIpReputationList", "GenericLFI_Body", "RCE-Command-Exec",
    "Default_Action", "ScriptFilter", "HostHeader",
]
EVENT_ACTIONS = {"error": "BLOCK", "view": "ALLOW", "click": "COUNT", "purchase": "CAPTCHA", "signup": "CHALLENGE"}
STATEMENT_KEYS = [
    "ManagedRuleGroupStatement", "RateBasedStatement", "RuleGroupReferenceStatement", "GeoMatchStatement",
    "IPSetReferenceStatement", "RegexPatternSetReferenceStatement", "SizeConstraintStatement", "SqliMatchStatement",
    "XssMatchStatement", "ByteMatchStatement", "NotStatement", "LabelMatchStatement",
]
RULE_ACTION_TEXTS = ['{"Allow":{}}', '{"Block":{}}', '{"Count":{}}', '{"Captcha":{}}', "{}", "", "{bad"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    """values[index], null past the end."""
    return F.get(F.array(*map(F.lit, values)), index.cast("int"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def acl_count(spark: SparkSession, d: str) -> Column:
    return table(spark, d, "supplier").agg(F.count(F.lit(1))).scalar()


def logs(spark: SparkSession, d: str) -> DataFrame:
    """Normalised logs from events."""
    ev = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k, user = F.col("k"), F.col("user_id")
    country = (F.col("event_id") % 25).cast("int")
    named = F.concat(F.lit("N"), F.lpad(country.cast("string"), 2, "0"))
    return ev.select(
        F.col("event_id").alias("log_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(k % 50 == 49, "acl-retired").otherwise(F.concat(F.lit("acl-"), (user % acl_count(spark, d)).cast("string"))).alias("web_acl_id"),
        labels.lookup(F.col("event_type"), EVENT_ACTIONS).alias("action"),
        F.when(k % 17 != 0, F.concat_ws(".", F.lit("10.0"), F.floor(user / 256).cast("string"), (user % 256).cast("string"))).alias("client_ip"),
        F.when(country == 0, "-").when(country > 1, named).alias("country"),
        F.concat(F.lit("/p/"), (F.col("event_id") % 97).cast("string")).alias("uri"),
        F.when(k % 2 == 0, "GET").otherwise("POST").alias("http_method"),
        F.lit("HTTP/2.0").alias("http_version"),
        F.when(k % 19 != 0, F.get(F.array(F.lit(200), F.lit(403), F.lit(404)), k % 3)).alias("http_status"),
        pick(RULE_NAMES, k % 13).alias("terminating_rule_id"),
        pick(["REGULAR", "MANAGED_RULE_GROUP", "RATE_BASED"], k % 3).alias("terminating_rule_type"),
        F.when(k % 3 != 0, F.concat(F.lit("ja3-"), (k % 7).cast("string"))).alias("ja3_fingerprint"),
        F.when(k % 4 != 0, F.concat(F.lit("ja4-"), (k % 7).cast("string"))).alias("ja4_fingerprint"),
        F.when(k % 11 != 0, F.concat(F.lit("agent/"), (k % 29).cast("string"))).alias("user_agent"),
        k.alias("k"),
    )


def traffic(spark: SparkSession, d: str) -> DataFrame:
    """The larger log, from lineitem: one client per order."""
    li = table(spark, d, "lineitem")
    o = F.col("l_orderkey")
    octet = lambda shift: (F.shiftright(o, shift) % 256).cast("string")
    country = (F.col("l_partkey") % 25).cast("int")
    return li.select(
        (F.col("l_shipdate").cast("timestamp") + F.make_interval(hours=F.col("l_linenumber"))).alias("timestamp"),
        F.concat(F.lit("acl-"), F.col("l_suppkey").cast("string")).alias("web_acl_id"),
        F.when(F.col("l_returnflag") == "R", "BLOCK").when(F.col("l_linestatus") == "F", "ALLOW").otherwise("COUNT").alias("action"),
        F.concat_ws(".", F.lit("10"), octet(16), octet(8), octet(0)).alias("client_ip"),
        F.when(country == 0, "-").when(country > 1, F.concat(F.lit("N"), F.lpad(country.cast("string"), 2, "0"))).alias("country"),
        pick(RULE_NAMES, F.col("l_partkey") % 13).alias("terminating_rule_id"),
        pick(["REGULAR", "MANAGED_RULE_GROUP", "RATE_BASED"], F.col("l_partkey") % 3).alias("terminating_rule_type"),
        F.when(F.col("l_partkey") % 3 != 0, "ja3").alias("ja3_fingerprint"),
        F.when(F.col("l_partkey") % 4 != 0, "ja4").alias("ja4_fingerprint"),
        F.concat(F.lit("agent/"), (o % 29).cast("string")).alias("user_agent"),
    )


def acls(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        F.concat(F.lit("acl-"), key.cast("string")).alias("web_acl_id"),
        F.col("s_name").alias("name"),
        F.when(F.col("s_nationkey") % 2 == 0, "REGIONAL").otherwise("CLOUDFRONT").alias("scope"),
        F.when(key % 3 == 0, '{"Block":{}}').when(key % 3 == 1, '{"Allow":{}}').otherwise("NONE").alias("default_action"),
        F.floor(F.abs("s_acctbal")).cast("bigint").alias("capacity"),
    )


def rules(spark: SparkSession, d: str) -> DataFrame:
    n, key = acl_count(spark, d), F.col("p_partkey")
    slot = F.floor(key / F.col("n")).cast("bigint")
    name = F.when(slot < 12, pick(RULE_NAMES, F.least(slot, F.lit(12)))).otherwise(F.concat(F.lit("Unused-"), slot.cast("string")))
    statement = F.concat(
        F.lit('{"'), pick(STATEMENT_KEYS, key % 12), F.lit('":{"VendorName":"Vendor-'), (key % 3).cast("string"),
        F.lit('","Name":"'), F.col("p_brand"), F.lit('","Version":"'), F.col("p_size").cast("string"), F.lit('"}}'),
    )
    acl = F.concat(F.lit("acl-"), (key % F.col("n")).cast("string"))
    return (
        table(spark, d, "part").withColumn("n", n)
        .select(acl.alias("web_acl_id"), name.alias("name"), F.col("p_size").alias("priority"), statement.alias("statement"),
                pick(RULE_ACTION_TEXTS, key % 7).alias("action"), key.alias("position"))
        .withColumn("rule_id", upsert.rule_key())
        .withColumn("rule_type", labels.rule_type("statement"))
    )


def resources(spark: SparkSession, d: str) -> DataFrame:
    """One association per customer. The last ACL number does not exist."""
    key = F.col("c_custkey")
    kinds = ["elasticloadbalancing", "apigateway", "cloudfront", "appsync"]
    paths = ["loadbalancer/app/", "/restapis/", "distribution/", "apis:"]
    kind = F.col("c_nationkey") % 4
    arn = F.concat(F.lit("arn:aws:"), pick(kinds, kind), F.lit(":us-east-1:123456789012:"), pick(paths, kind), F.lit("r"), key.cast("string"))
    acl = F.concat(F.lit("acl-"), (key % (F.col("n") + 1)).cast("string"))
    return (
        table(spark, d, "customer").withColumn("n", acl_count(spark, d))
        .select(acl.alias("web_acl_id"), arn.alias("resource_arn"))
        .withColumn("resource_type", arns.resource_type("resource_arn"))
        .withColumn("association_id", upsert.resource_key())
    )


def logging_dump(spark: SparkSession, d: str) -> DataFrame:
    """Per supplier a list of none, one or two destinations."""
    key = F.col("s_suppkey").cast("string")
    group = F.concat(F.lit("arn:aws:logs:us-east-1:123456789012:log-group:aws-waf-logs-"), key, F.lit(":*"))
    store = F.concat(F.lit("arn:aws:s3:::aws-waf-logs-"), key, F.lit("/AWSLogs/"), key)
    hose = F.concat(F.lit("arn:aws:firehose:us-east-1:123456789012:deliverystream/aws-waf-logs-"), key)
    odd = F.concat(F.lit("arn:aws:sns:us-east-1:123456789012:waf-"), key)
    other = F.concat(F.lit("arn:aws:s3:::second-"), key)
    turn = F.col("s_suppkey") % 6
    lists = [F.array(group), F.array(store, other), F.array(hose), F.array(odd), F.array(group, store)]
    chosen = F.when(turn == 0, lists[0])
    for i in range(1, 5):
        chosen = chosen.when(turn == i, lists[i])
    return table(spark, d, "supplier").select(
        F.concat(F.lit("acl-"), key).alias("web_acl_id"),
        F.coalesce(chosen, F.array().cast("array<string>")).alias("destinations"),
        F.when(F.col("s_nationkey") % 2 == 0, "JSON").alias("log_format"),
        F.when(F.col("s_nationkey") % 3 == 0, F.lit(0.5)).alias("sampling_rate"),
    )


def logging(spark: SparkSession, d: str) -> DataFrame:
    rows = upsert.logging_rows(logging_dump(spark, d))
    return upsert.latest_per_key(rows, "config_id", ["position"])


def files(spark: SparkSession, d: str) -> DataFrame:
    """A file listing from orders."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    at = day + F.make_interval(hours=(key % 24).cast("int"), mins=(key % 60).cast("int"))
    base = F.concat(F.lit("AWSLogs/123456789012/WAFLogs/us-east-1/acl-"), F.col("o_custkey").cast("string"))
    dated = F.concat(base, F.lit("/"), F.date_format(at, "yyyy/MM/dd/HH"), F.lit("/123456789012_waflogs_us-east-1_"),
                     F.date_format(at, "yyyyMMdd'T'HHmm'Z'"), F.lit("_"), key.cast("string"))
    plain = F.concat(base, F.lit("/undated/"), key.cast("string"))
    suffix = pick([".log.gz", ".json", ".txt"], key % 3)
    return table(spark, d, "orders").select(
        F.concat(F.when(key % 10 == 9, plain).otherwise(dated), suffix).alias("path"),
        F.floor("o_totalprice").cast("bigint").alias("length"),
        at.alias("modificationTime"),
        F.concat(F.lit("acl-"), F.col("o_custkey").cast("string")).alias("web_acl_id"),
    )


def raw_logs(spark: SparkSession, d: str) -> DataFrame:
    """Raw record text for every log, in all the shapes the fields come in."""
    k, ts = F.col("k"), F.col("timestamp")
    stamp = (
        F.when(k % 23 == 0, F.lit(""))
        .when(k % 4 == 0, F.concat(F.lit('"timestamp":'), F.unix_millis(ts).cast("string"), F.lit(",")))
        .when(k % 4 == 1, F.concat(F.lit('"timestamp":'), F.unix_seconds(ts).cast("string"), F.lit(",")))
        .when(k % 4 == 2, F.concat(F.lit('"timestamp":"'), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit('",')))
        .otherwise(F.concat(F.lit('"timestamp":"'), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit('",')))
    )
    full = F.concat(F.lit("arn:aws:wafv2:us-east-1:123456789012:regional/webacl/name/"), F.col("web_acl_id"))
    acl = F.when(k % 3 == 0, F.concat(F.lit('"webaclId":"'), full, F.lit('",'))).when(
        k % 3 == 1, F.concat(F.lit('"webaclId":"'), F.col("web_acl_id"), F.lit('",'))
    ).otherwise(F.concat(F.lit('"webaclId":"","webAclId":"'), F.col("web_acl_id"), F.lit('",')))
    action = F.when(k == 98, "").when(k == 97, "EXCLUDED").otherwise(F.col("action"))
    agent = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    headers = F.when(
        F.col("user_agent").isNotNull(),
        F.array(agent("Host", F.lit('a "quoted" {host}')), agent("USER-AGENT", F.col("user_agent")), agent("user-agent", F.lit("second"))),
    ).otherwise(F.array(agent("Host", F.lit("b"))))
    inside = k % 2 == 0
    body = F.struct(
        F.lit(1).alias("formatVersion"),
        action.alias("action"),
        F.col("terminating_rule_id").alias("terminatingRuleId"),
        F.col("terminating_rule_type").alias("terminatingRuleType"),
        F.when(k % 5 == 0, F.array(F.struct(F.lit("SQL_INJECTION").alias("conditionType"), F.lit("URI").alias("location")))).alias("terminatingRuleMatchDetails"),
        F.when(k % 5 != 1, F.array(
            F.struct(F.when(k % 2 == 0, F.concat(F.lit("grp-"), (k % 6).cast("string"))).alias("ruleGroupId"), F.lit("named").alias("ruleGroupName")),
            F.struct(F.lit("").alias("ruleGroupId"), F.lit(None).cast("string").alias("ruleGroupName")),
        )).alias("ruleGroupList"),
        F.when(k % 7 == 0, F.array(F.struct(F.concat(F.lit("label:"), (k % 9).cast("string")).alias("name")))).alias("labels"),
        F.struct(
            F.when(inside, F.col("client_ip")).otherwise("").alias("clientIp"),
            F.col("country").alias("country"),
            F.col("uri").alias("uri"),
            F.col("http_method").alias("httpMethod"),
            F.col("http_version").alias("httpVersion"),
            headers.alias("headers"),
        ).alias("httpRequest"),
        F.when(~inside, F.col("client_ip")).alias("clientIp"),
        F.col("http_status").alias("httpStatus"),
        F.col("ja3_fingerprint").alias("ja3Fingerprint"),
        F.col("ja4_fingerprint").alias("ja4Fingerprint"),
    )
    text = F.concat(F.lit("{"), stamp, acl, F.substring(F.to_json(body), 2, 1 << 30))
    return logs(spark, d).select("log_id", "k", "timestamp", "web_acl_id", text.alias("value"))


SQL_VIEWS: dict[str, str] = {
    "v_n": "SELECT count(*) AS n FROM supplier",
    "v_logs": f"""
        SELECT event_id AS log_id, ts AS timestamp,
          CASE WHEN k % 50 = 49 THEN 'acl-retired' ELSE 'acl-' || CAST(user_id % n AS VARCHAR) END AS web_acl_id,
          CASE event_type {' '.join(f"WHEN '{e}' THEN '{a}'" for e, a in EVENT_ACTIONS.items())} END AS action,
          CASE WHEN k % 17 <> 0 THEN '10.0.' || CAST(user_id // 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) END AS client_ip,
          CASE WHEN event_id % 25 = 0 THEN '-' WHEN event_id % 25 > 1 THEN 'N' || lpad(CAST(event_id % 25 AS VARCHAR), 2, '0') END AS country,
          '/p/' || CAST(event_id % 97 AS VARCHAR) AS uri,
          CASE WHEN k % 2 = 0 THEN 'GET' ELSE 'POST' END AS http_method,
          'HTTP/2.0' AS http_version,
          CASE WHEN k % 19 <> 0 THEN ([200, 403, 404])[k % 3 + 1] END AS http_status,
          ({_sql_list(RULE_NAMES)})[k % 13 + 1] AS terminating_rule_id,
          (['REGULAR', 'MANAGED_RULE_GROUP', 'RATE_BASED'])[k % 3 + 1] AS terminating_rule_type,
          CASE WHEN k % 3 <> 0 THEN 'ja3-' || CAST(k % 7 AS VARCHAR) END AS ja3_fingerprint,
          CASE WHEN k % 4 <> 0 THEN 'ja4-' || CAST(k % 7 AS VARCHAR) END AS ja4_fingerprint,
          CASE WHEN k % 11 <> 0 THEN 'agent/' || CAST(k % 29 AS VARCHAR) END AS user_agent,
          k
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events), v_n""",
    "v_traffic": f"""
        SELECT l_shipdate + to_hours(l_linenumber) AS timestamp, 'acl-' || CAST(l_suppkey AS VARCHAR) AS web_acl_id,
          CASE WHEN l_returnflag = 'R' THEN 'BLOCK' WHEN l_linestatus = 'F' THEN 'ALLOW' ELSE 'COUNT' END AS action,
          '10.' || CAST((l_orderkey >> 16) % 256 AS VARCHAR) || '.' || CAST((l_orderkey >> 8) % 256 AS VARCHAR) || '.' || CAST(l_orderkey % 256 AS VARCHAR) AS client_ip,
          CASE WHEN l_partkey % 25 = 0 THEN '-' WHEN l_partkey % 25 > 1 THEN 'N' || lpad(CAST(l_partkey % 25 AS VARCHAR), 2, '0') END AS country,
          ({_sql_list(RULE_NAMES)})[l_partkey % 13 + 1] AS terminating_rule_id,
          (['REGULAR', 'MANAGED_RULE_GROUP', 'RATE_BASED'])[l_partkey % 3 + 1] AS terminating_rule_type
        FROM lineitem""",
    "v_acls": """
        SELECT 'acl-' || CAST(s_suppkey AS VARCHAR) AS web_acl_id, s_name AS name,
          CASE WHEN s_nationkey % 2 = 0 THEN 'REGIONAL' ELSE 'CLOUDFRONT' END AS scope,
          CASE s_suppkey % 3 WHEN 0 THEN '{"Block":{}}' WHEN 1 THEN '{"Allow":{}}' ELSE 'NONE' END AS default_action,
          CASE s_suppkey % 3 WHEN 0 THEN 'BLOCK' WHEN 1 THEN 'ALLOW' ELSE 'NONE' END AS default_label,
          CAST(floor(abs(s_acctbal)) AS BIGINT) AS capacity
        FROM supplier""",
    "v_rules": f"""
        SELECT web_acl_id, name, priority, statement, action, web_acl_id || '_' || name AS rule_id, rule_type, p_partkey, p_brand, p_size FROM (
          SELECT 'acl-' || CAST(p_partkey % n AS VARCHAR) AS web_acl_id,
            CASE WHEN p_partkey // n < 12 THEN ({_sql_list(RULE_NAMES)})[p_partkey // n + 1] ELSE 'Unused-' || CAST(p_partkey // n AS VARCHAR) END AS name,
            p_size AS priority,
            '{{"' || ({_sql_list(STATEMENT_KEYS)})[p_partkey % 12 + 1] || '":{{"VendorName":"Vendor-' || CAST(p_partkey % 3 AS VARCHAR)
              || '","Name":"' || p_brand || '","Version":"' || CAST(p_size AS VARCHAR) || '"}}}}' AS statement,
            ({_sql_list(RULE_ACTION_TEXTS)})[p_partkey % 7 + 1] AS action,
            (['MANAGED_RULE_GROUP', 'RATE_BASED', 'RULE_GROUP_REFERENCE', 'GEO_MATCH', 'IP_SET', 'REGEX_PATTERN_SET',
              'SIZE_CONSTRAINT', 'SQLI_MATCH', 'XSS_MATCH', 'BYTE_MATCH', 'LOGICAL', 'CUSTOM'])[p_partkey % 12 + 1] AS rule_type,
            p_partkey, p_brand, p_size
          FROM part, v_n)""",
    "v_resources": """
        SELECT web_acl_id, resource_arn, resource_type, web_acl_id || '_' || resource_arn AS association_id, c_custkey FROM (
          SELECT 'acl-' || CAST(c_custkey % (n + 1) AS VARCHAR) AS web_acl_id,
            'arn:aws:' || (['elasticloadbalancing', 'apigateway', 'cloudfront', 'appsync'])[c_nationkey % 4 + 1] || ':us-east-1:123456789012:'
              || (['loadbalancer/app/', '/restapis/', 'distribution/', 'apis:'])[c_nationkey % 4 + 1] || 'r' || CAST(c_custkey AS VARCHAR) AS resource_arn,
            (['ALB', 'API_GATEWAY', 'CLOUDFRONT', 'UNKNOWN'])[c_nationkey % 4 + 1] AS resource_type, c_custkey
          FROM customer, v_n)""",
    "v_dump": """
        SELECT 'acl-' || key AS web_acl_id,
          CASE t WHEN 0 THEN [grp] WHEN 1 THEN [store, 'arn:aws:s3:::second-' || key] WHEN 2 THEN [hose] WHEN 3 THEN [odd] WHEN 4 THEN [grp, store] ELSE [] END AS destinations,
          log_format, sampling_rate
        FROM (SELECT s_suppkey % 6 AS t, CAST(s_suppkey AS VARCHAR) AS key,
          'arn:aws:logs:us-east-1:123456789012:log-group:aws-waf-logs-' || CAST(s_suppkey AS VARCHAR) || ':*' AS grp,
          'arn:aws:s3:::aws-waf-logs-' || CAST(s_suppkey AS VARCHAR) || '/AWSLogs/' || CAST(s_suppkey AS VARCHAR) AS store,
          'arn:aws:firehose:us-east-1:123456789012:deliverystream/aws-waf-logs-' || CAST(s_suppkey AS VARCHAR) AS hose,
          'arn:aws:sns:us-east-1:123456789012:waf-' || CAST(s_suppkey AS VARCHAR) AS odd,
          CASE WHEN s_nationkey % 2 = 0 THEN 'JSON' END AS log_format,
          CASE WHEN s_nationkey % 3 = 0 THEN 0.5::DOUBLE END AS sampling_rate FROM supplier)""",
    "v_logging": """
        SELECT web_acl_id || '_' || destination_type AS config_id, web_acl_id, destination_type, arg_max(destination_arn, position) AS destination_arn,
          coalesce(any_value(log_format), 'JSON') AS log_format, coalesce(any_value(sampling_rate), 1.0::DOUBLE) AS sampling_rate
        FROM (SELECT *, CASE WHEN contains(destination_arn, 'logs:') THEN 'CLOUDWATCH' WHEN contains(destination_arn, 's3:') THEN 'S3'
                 WHEN contains(destination_arn, 'firehose:') THEN 'FIREHOSE' ELSE 'UNKNOWN' END AS destination_type
              FROM (SELECT web_acl_id, log_format, sampling_rate, unnest(destinations) AS destination_arn,
                    generate_subscripts(destinations, 1) - 1 AS position FROM v_dump))
        GROUP BY web_acl_id, destination_type""",
    "v_files": """
        SELECT CASE WHEN o_orderkey % 10 = 9 THEN base || '/undated/' || CAST(o_orderkey AS VARCHAR)
            ELSE base || '/' || strftime(tm, '%Y/%m/%d/%H') || '/123456789012_waflogs_us-east-1_' || strftime(tm, '%Y%m%dT%H%MZ') || '_' || CAST(o_orderkey AS VARCHAR) END
            || (['.log.gz', '.json', '.txt'])[o_orderkey % 3 + 1] AS path,
          CAST(floor(o_totalprice) AS BIGINT) AS length, tm AS modificationTime, 'acl-' || CAST(o_custkey AS VARCHAR) AS web_acl_id,
          o_orderkey % 10 = 9 AS undated, o_orderkey % 3 AS kind, date_trunc('hour', tm) AS hour, date_trunc('minute', tm) AS minute
        FROM (SELECT *, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) + to_minutes(CAST(o_orderkey % 60 AS INTEGER)) AS tm,
          'AWSLogs/123456789012/WAFLogs/us-east-1/acl-' || CAST(o_custkey AS VARCHAR) AS base FROM orders)""",
    # what normalising the raw text of a log must give
    "v_norm": """
        SELECT log_id, k,
          CASE WHEN k % 23 = 0 THEN NULL WHEN k % 4 = 1 THEN date_trunc('second', timestamp) ELSE date_trunc('milliseconds', timestamp) END AS timestamp,
          web_acl_id, CASE k WHEN 98 THEN 'UNKNOWN' WHEN 97 THEN 'EXCLUDED' ELSE action END AS action, client_ip, country, uri, http_method,
          http_version, http_status, terminating_rule_id, terminating_rule_type, ja3_fingerprint, ja4_fingerprint, user_agent
        FROM v_logs""",
}
