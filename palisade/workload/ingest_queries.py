"""Reading, decoding, normalising, appending and writing logs.

The raw text of every log is made from the event table, in the shapes raw files
come in, and goes through the real readers: the result must be the columns it
was made from. Queries that need files write them to the shared folder first.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arns, labels, records, times
from ..functions.numbers import count_when
from ..operators import append, metrics, normalize, quality, sinks, store
from ..operators.ordering import number_rows
from ..session import scratch_path
from ..sources import concatenated, events, paths, raw, tables
from . import views as v
from .metric_queries import attack_case
from .registry import query

N = "CAST(count(*) AS BIGINT)"
FIELDS = [
    "timestamp", "web_acl_id", "action", "client_ip", "country", "uri", "http_method", "http_version", "http_status",
    "terminating_rule_id", "terminating_rule_type", "ja3_fingerprint", "ja4_fingerprint", "user_agent",
]
NORM = f"SELECT {', '.join(FIELDS)} FROM v_norm"


def normalized(decoded: DataFrame) -> DataFrame:
    return normalize.normalize_logs(decoded).select(*FIELDS)


def text_files(s, df: DataFrame, label: str, text: str = "value", **options) -> str:
    path = scratch_path(s, label)
    df.select(F.col(text).alias("value")).write.options(**options).text(path)
    return path


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


# decoding
@query("normalize_logs", NORM.replace(" FROM", ", to_timestamp(1000)::TIMESTAMP AS created_at FROM"))
def normalize_logs(s, d):
    loaded = normalize.normalize_logs(raw.decode_lines(v.raw_logs(s, d)), as_of=F.timestamp_seconds(F.lit(1000)))
    return loaded.select(*FIELDS, "created_at")


@query("scan_jsonl", NORM)
def scan_jsonl(s, d):
    rows = v.raw_logs(s, d)
    plain = text_files(s, rows.where(F.col("k") < 50), "plain")
    packed = text_files(s, rows.where(F.col("k") >= 50), "packed", compression="gzip")
    return normalized(raw.decode_lines(raw.scan_lines(s, [plain, packed], "part-*")))


@query("scan_concat_json", NORM)
def scan_concat_json(s, d):
    """Objects over many lines, the next one right behind the last brace, with
    broken text between some of them, indented more and less than they are. One in ten is
    in plain files, which are read in blocks, the others are packed."""
    k = F.col("k")
    lines = F.replace("value", F.lit(',"'), F.lit(',\n  "'))
    broken = (
        F.when(k % 10 == 3, "\nnot json\n").when(k % 10 == 4, '\n{"cut": 1, "a\n').when(k % 10 == 5, "\nends with,\n")
        .when(k % 10 == 6, " \n\n").when(k % 10 == 7, '\n    {"open": [\n        {"x": 1,\n')
        .when(k % 10 == 8, '\n{"list": [\n  {"y": \n]\n').otherwise("")
    )
    rows, split = v.raw_logs(s, d), F.coalesce(k < 10, F.lit(False))
    plain, packed = (
        text_files(s, rows.where(chosen).select(F.concat(lines, broken).alias("value")), "concat", lineSep=" ", maxRecordsPerFile=100_000, compression=how)
        for chosen, how in ((split, "none"), (~split, "gzip"))
    )
    return normalized(raw.decode_lines(concatenated.scan_concatenated(s, [plain, packed], "part-*")))


@query("scan_indented_json", NORM)
def scan_indented_json(s, d):
    body = F.concat(F.lit("{\n  "), F.expr("substring(value, 2, length(value) - 2)"), F.lit("\n}"))
    path = text_files(s, v.raw_logs(s, d).select(body.alias("value")), "indented", compression="gzip")
    return normalized(raw.decode_lines(raw.scan_indented(s, path, "part-*")))


def export_rows(s, d) -> DataFrame:
    message = F.concat(
        F.lit('{"@message":'), quoted(F.col("value")), F.lit(',"@timestamp":"'), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS"),
        F.lit('","@ptr":"p'), F.col("log_id").cast("string"), F.lit('"}'),
    )
    return v.raw_logs(s, d).select("log_id", "k", message.alias("value"))


@query("decode_cw_export", """SELECT n.web_acl_id, n.action, n.client_ip, n.timestamp, 'cloudwatch_export' AS source, 'p' || CAST(n.log_id AS VARCHAR) AS export_ptr,
  strftime(l.timestamp, '%Y-%m-%d %H:%M:%S.%g') AS export_time FROM v_norm n JOIN v_logs l USING (log_id)""")
def decode_cw_export(s, d):
    decoded = raw.decode_exports(export_rows(s, d))
    logs = normalize.normalize_logs(decoded.withColumn("path", F.concat_ws("|", "export_ptr", "export_time")))
    return logs.select("web_acl_id", "action", "client_ip", "timestamp", "source",
                       F.split_part("path", F.lit("|"), F.lit(1)).alias("export_ptr"), F.split_part("path", F.lit("|"), F.lit(2)).alias("export_time"))


@query("decode_cw_event", """SELECT web_acl_id, action, client_ip, timestamp, 'cloudwatch' AS source, 'e' || CAST(log_id AS VARCHAR) AS event_id, 1700000000000 + log_id AS ingestion_time FROM v_norm""")
def decode_cw_event(s, d):
    k, text = F.col("k"), quoted(F.col("value"))
    body = (
        F.when(k % 4 == 0, F.concat(F.lit('"@message":"","message":'), text))
        .when(k % 4 == 1, F.concat(F.lit('"Message":'), text))
        .when(k % 4 == 2, F.concat(F.lit('"message":'), F.col("value")))
        .otherwise(F.concat(F.lit('"@message":'), text, F.lit(',"message":"ignored"')))
    )
    row = F.concat(F.lit('{"eventId":"e'), F.col("log_id").cast("string"), F.lit('","ingestionTime":'), (F.col("log_id") + 1700000000000).cast("string"), F.lit(","), body, F.lit("}"))
    decoded = raw.decode_events(v.raw_logs(s, d).select(row.alias("value")))
    tagged = decoded.withColumn("path", F.concat_ws("|", "event_id", F.col("ingestion_time").cast("string")))
    logs = normalize.normalize_logs(tagged)
    return logs.select("web_acl_id", "action", "client_ip", "timestamp", "source",
                       F.split_part("path", F.lit("|"), F.lit(1)).alias("event_id"), F.split_part("path", F.lit("|"), F.lit(2)).cast("bigint").alias("ingestion_time"))


@query("decode_string_record", NORM + " WHERE k % 20 <> 7")
def decode_string_record(s, d):
    text = F.when(F.col("k") % 20 == 7, '"[1]"').otherwise(quoted(F.col("value")))
    return normalized(raw.decode_string_records(v.raw_logs(s, d).select(text.alias("value"))))


def mixed_rows(s, d) -> DataFrame:
    """Plain, string, envelope and damaged rows; `day` stands for the file."""
    k, value = F.col("k"), F.col("value")
    envelope = F.concat(F.lit('{"@message":'), quoted(value), F.lit("}"))
    text = (
        F.when(k % 10 == 0, F.expr("left(value, length(value) - 2)"))
        .when(k % 10 == 1, '{"@message":""}')
        .when(k % 10 == 2, F.concat(F.lit('{"@message":'), value, F.lit("}")))
        .when(k % 10 == 3, '"[1, 2]"')
        .when(k % 10 == 4, "17")
        .when(k % 10 == 5, quoted(value))
        .when(k % 10 < 8, envelope)
        .otherwise(value)
    )
    return v.raw_logs(s, d).select("log_id", "k", F.to_date("timestamp").alias("day"), text.alias("value"))


@query("parse_summary", f"""SELECT CAST(timestamp AS DATE) AS day, {N} AS found, count(CASE WHEN k % 10 <> 0 THEN 1 END) AS processed,
  count(CASE WHEN k % 10 >= 5 THEN 1 END) AS valid, count(CASE WHEN k % 10 IN (0, 2, 3, 4) THEN 1 END) AS invalid, count(CASE WHEN k % 10 = 1 THEN 1 END) AS skipped
FROM v_logs GROUP BY 1""")
def parse_summary(s, d):
    return raw.parse_summary(raw.decode_any(mixed_rows(s, d)), "day")


@query("reject_rows", "SELECT log_id, CASE WHEN k % 10 = 1 THEN 'skipped' ELSE 'invalid' END AS decode_status FROM v_logs WHERE k % 10 < 5")
def reject_rows(s, d):
    return raw.reject_rows(raw.decode_any(mixed_rows(s, d))).select("log_id", "decode_status")


@query("scan_mixed_records", NORM + " WHERE k % 10 >= 5")
def scan_mixed_records(s, d):
    return normalized(raw.decode_any(mixed_rows(s, d)))


# normalisation, field by field
@query("norm_timestamp", "SELECT log_id, timestamp FROM v_norm")
def norm_timestamp(s, d):
    found = F.try_variant_get(F.try_parse_json("value"), "$.timestamp", "string")
    return v.raw_logs(s, d).select("log_id", found.alias("t")).select("log_id", times.normalize_timestamp("t").alias("timestamp"))


@query("to_epoch_ms", "SELECT log_id, epoch_us(timestamp) // 1000 AS ms FROM v_logs")
def to_epoch_ms(s, d):
    return v.logs(s, d).select("log_id", times.epoch_ms("timestamp").alias("ms"))


@query("norm_action", "SELECT log_id, action, action IN ('ALLOW', 'BLOCK', 'COUNT', 'CAPTCHA', 'CHALLENGE') AS known FROM v_norm")
def norm_action(s, d):
    text = F.get_json_object("value", "$.action")
    return v.raw_logs(s, d).select("log_id", labels.norm_action(text).alias("action")).withColumn("known", labels.known_action("action"))


@query("norm_acl_id", "SELECT log_id, web_acl_id FROM v_norm")
def norm_acl_id(s, d):
    full = records.first_filled(F.get_json_object("value", "$.webaclId"), F.get_json_object("value", "$.webAclId"))
    return v.raw_logs(s, d).select("log_id", full.alias("a")).select("log_id", arns.acl_id("a").alias("web_acl_id"))


@query("norm_http_fields", "SELECT log_id, client_ip, country, uri, http_method, http_version FROM v_norm")
def norm_http_fields(s, d):
    parsed = v.raw_logs(s, d).select("log_id", F.try_parse_json("value").alias("record"))
    names = {"client_ip": "clientIp", "country": "country", "uri": "uri", "http_method": "httpMethod", "http_version": "httpVersion"}
    return parsed.select("log_id", *[normalize.request_field(f).alias(n) for n, f in names.items()])


@query("extract_user_agent", "SELECT log_id, user_agent FROM v_norm")
def extract_user_agent(s, d):
    from ..schemas import HEADERS

    headers = F.try_variant_get(F.try_parse_json("value"), "$.httpRequest.headers", HEADERS)
    return v.raw_logs(s, d).select("log_id", headers.alias("h")).select("log_id", records.user_agent("h").alias("user_agent"))


@query("rule_groups_hit", f"""SELECT rule_group, {N} AS hits FROM (SELECT CASE WHEN k % 2 = 0 THEN 'grp-' || CAST(k % 6 AS VARCHAR) ELSE 'named' END AS rule_group
  FROM v_logs WHERE k % 5 <> 1) GROUP BY 1""")
def rule_groups_hit(s, d):
    return normalize.rule_group_hits(normalize.normalize_logs(raw.decode_lines(v.raw_logs(s, d))))


@query("attack_type_log", f"""SELECT log_id, CASE WHEN action = 'BLOCK' THEN {attack_case("coalesce(terminating_rule_id, '')", labels.ATTACKS_BY_REQUEST)} ELSE 'N/A' END AS attack_type FROM v_logs""")
def attack_type_log(s, d):
    return v.logs(s, d).select("log_id", labels.attack_of_request("action", "terminating_rule_id").alias("attack_type"))


@query("attack_type_metric", f"SELECT log_id, {attack_case('terminating_rule_id')} AS attack_type FROM v_logs WHERE terminating_rule_id IS NOT NULL")
def attack_type_metric(s, d):
    named = v.logs(s, d).where(F.col("terminating_rule_id").isNotNull())
    return named.select("log_id", labels.attack_of_rule("terminating_rule_id").alias("attack_type"))


@query("nested_to_json", """SELECT uri, timestamp, CASE WHEN k % 5 = 0 THEN '[{"conditionType":"SQL_INJECTION","location":"URI"}]' END AS terminating_rule_match_details,
  CASE WHEN k % 7 = 0 THEN '[{"name":"label:' || CAST(k % 9 AS VARCHAR) || '"}]' ELSE '[]' END AS labels, '[]' AS rate_based_rule_list FROM v_norm""")
def nested_to_json(s, d):
    logs = normalize.nested_to_json(normalize.normalize_logs(raw.decode_lines(v.raw_logs(s, d))))
    return logs.select("uri", "timestamp", "terminating_rule_match_details", "labels", "rate_based_rule_list")


REQUIRED = {"timestamp": "timestamp", "action": "action", "clientIp": "client_ip", "country": "country", "uri": "uri",
            "httpMethod": "http_method", "httpVersion": "http_version", "httpStatus": "http_status"}
REASONS = ", ".join(f"CASE WHEN {c} IS NULL THEN 'missing:{n}' END" for n, c in REQUIRED.items())


@query("validate_logs", f"""SELECT reasons, reasons = '' AS is_valid, {N} AS logs FROM (SELECT concat_ws(';', {REASONS},
  CASE WHEN action NOT IN ('ALLOW', 'BLOCK', 'COUNT', 'CAPTCHA', 'CHALLENGE') THEN 'invalid:action' END) AS reasons FROM v_norm) GROUP BY 1, 2""")
def validate_logs(s, d):
    logs = normalize.normalize_logs(raw.decode_lines(v.raw_logs(s, d)))
    return quality.validate_logs(logs, REQUIRED, "action").groupBy("reasons", "is_valid").agg(metrics.n_rows().alias("logs"))


# files by path and time
FIRST, LAST = datetime(1998, 3, 5, 12, 30), datetime(2000, 11, 20, 6)
BOUNDS = f"TIMESTAMP '{FIRST}' AND TIMESTAMP '{LAST}'"


def order_range(s, d) -> DataFrame:
    day = F.col("o_orderdate").cast("timestamp")
    ends = v.table(s, d, "orders").agg(F.min(day).alias("start"), F.max(day).alias("end"))
    return ends.select(F.lit("AWSLogs/WAFLogs/").alias("base_prefix"), "start", "end")


@query("prune_date_prefixes", """SELECT 'AWSLogs/WAFLogs/' || strftime(day, '%Y/%m/%d/') AS prefix, CAST(count(o_orderkey) AS BIGINT) AS orders
FROM (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate), INTERVAL 1 DAY)) AS day FROM orders) LEFT JOIN orders ON o_orderdate = day GROUP BY 1""")
def prune_date_prefixes(s, d):
    per_day = v.table(s, d, "orders").groupBy(F.col("o_orderdate").cast("timestamp").alias("day")).agg(metrics.n_rows().alias("n"))
    days = paths.day_prefixes(order_range(s, d))
    return days.join(per_day, "day", "left").select("prefix", F.coalesce("n", F.lit(0)).alias("orders"))


@query("prune_hour_prefixes", """SELECT 'AWSLogs/WAFLogs/' || strftime(hour, '%Y/%m/%d/%H/') AS prefix
FROM (SELECT unnest(generate_series(min(o_orderdate), max(o_orderdate) + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS hour FROM orders)""")
def prune_hour_prefixes(s, d):
    return paths.hour_prefixes(order_range(s, d)).select("prefix")


@query("list_log_files", f"SELECT path, length, modificationTime FROM v_files WHERE modificationTime BETWEEN {BOUNDS}")
def list_log_files(s, d):
    return paths.modified_between(v.files(s, d), FIRST, LAST).select("path", "length", "modificationTime")


@query("filter_log_suffix", "SELECT path FROM v_files WHERE kind < 2")
def filter_log_suffix(s, d):
    return paths.log_files(v.files(s, d)).select("path")


@query("file_time_from_path", f"SELECT path, hour AS file_time FROM v_files WHERE NOT undated AND year(hour) >= 2000 AND hour + INTERVAL 1 HOUR > TIMESTAMP '{FIRST}' AND hour <= TIMESTAMP '{LAST}'")
def file_time_from_path(s, d):
    return paths.files_in_range(v.files(s, d), FIRST, LAST).select("path", "file_time")


@query("file_time_from_name", "SELECT path, CASE WHEN NOT undated THEN minute END AS file_time FROM v_files")
def file_time_from_name(s, d):
    return v.files(s, d).select("path", paths.file_time_from_name("path").alias("file_time"))


@query("estimate_volume_files", """SELECT total_size_bytes, total_objects, ((total_size_bytes * 200 + 1048576) // 2097152)::DOUBLE / 100.0 AS total_size_mb,
  total_size_bytes // 150 AS estimated_events, date_prefixes_scanned
FROM (SELECT CAST(sum(length) AS BIGINT) AS total_size_bytes, count(*) AS total_objects FROM v_files WHERE kind < 2),
  (SELECT date_diff('day', min(o_orderdate), max(o_orderdate)) + 1 AS date_prefixes_scanned FROM orders)""")
def estimate_volume_files(s, d):
    return paths.estimate_volume(v.files(s, d), paths.day_prefixes(order_range(s, d)))


@query("base_prefix_from_key", """SELECT web_acl_id, CASE WHEN NOT low_undated THEN 'AWSLogs/123456789012/WAFLogs/us-east-1/' || web_acl_id || '/'
    WHEN shared <> '' AND shared NOT LIKE '%/' THEN shared || '/' ELSE shared END AS base_prefix
FROM (SELECT web_acl_id, arg_min(undated, path) AS low_undated, left(min(path), list_max(list_filter(range(0, least(length(min(path)), length(max(path))) + 1),
    lambda i: left(min(path), i) = left(max(path), i)))) AS shared FROM v_files GROUP BY 1)""")
def base_prefix_from_key(s, d):
    return paths.base_prefix(v.files(s, d), "web_acl_id")


# landed events
START, END = datetime(2024, 1, 3, 2), datetime(2024, 1, 21, 9)
RANGE = f"timestamp BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"


@query("scan_events_range", f"SELECT log_id, timestamp, uri FROM v_logs WHERE {RANGE} AND contains(uri, '/p/1') ORDER BY timestamp, log_id LIMIT 500")
def scan_events_range(s, d):
    found = events.scan_range(v.logs(s, d), START, END, ["timestamp", "log_id"], "/p/1", "uri", 500)
    return found.select("log_id", "timestamp", "uri")


@query("scan_stream_partition", f"SELECT log_id, web_acl_id, timestamp FROM v_logs WHERE web_acl_id = 'acl-3' AND {RANGE}")
def scan_stream_partition(s, d):
    return events.scan_stream(v.logs(s, d), "web_acl_id", "acl-3", START, END).select("log_id", "web_acl_id", "timestamp")


@query("scan_time_chunks", " UNION ALL ".join(
    f"""SELECT {h} AS hours, chunk, TIMESTAMP '{START}' + to_hours(CAST(chunk * {h} AS INTEGER)) AS chunk_start,
  least(TIMESTAMP '{START}' + to_hours(CAST((chunk + 1) * {h} AS INTEGER)), TIMESTAMP '{END}') AS chunk_end, {N} AS logs
FROM (SELECT CAST((epoch_us(timestamp) - epoch_us(TIMESTAMP '{START}')) // ({h} * 3600000000) AS BIGINT) AS chunk FROM v_logs
  WHERE timestamp >= TIMESTAMP '{START}' AND timestamp < TIMESTAMP '{END}') GROUP BY chunk""" for h in (168, 6)))
def scan_time_chunks(s, d):
    out = None
    for hours in (168, 6):
        chunks = events.time_chunks(v.logs(s, d), START, END, hours).groupBy("chunk", "chunk_start", "chunk_end").agg(metrics.n_rows().alias("logs"))
        part = chunks.withColumn("hours", F.lit(hours))
        out = part if out is None else out.unionByName(part)
    return out


@query("list_log_groups", """SELECT '/' || c_mktsegment || '/' || CAST(c_custkey AS VARCHAR) AS log_group_name, CASE WHEN c_acctbal > 0 THEN CAST(floor(c_acctbal) AS BIGINT) ELSE 0 END AS creation_time
FROM customer WHERE c_mktsegment LIKE 'B%' ORDER BY creation_time DESC, log_group_name""")
def list_log_groups(s, d):
    groups = v.table(s, d, "customer").select(
        F.concat(F.lit("/"), "c_mktsegment", F.lit("/"), F.col("c_custkey").cast("string")).alias("log_group_name"),
        F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal").cast("bigint")).alias("creation_time"),
    )
    return events.log_groups(groups, "/B")


def streams(s, d) -> DataFrame:
    return v.logs(s, d).groupBy(F.col("web_acl_id").alias("stream_name")).agg(
        F.max(F.unix_millis("timestamp")).alias("last_event_ms"), F.sum(F.length("uri") + 100).cast("bigint").alias("stored_bytes")
    )


STREAMS = "SELECT web_acl_id AS stream_name, max(epoch_us(timestamp) // 1000) AS last_event_ms, CAST(sum(length(uri) + 100) AS BIGINT) AS stored_bytes FROM v_logs GROUP BY 1"


@query("list_log_streams", f"SELECT * FROM ({STREAMS}) WHERE last_event_ms BETWEEN 1706000000000 AND 1706650000000")
def list_log_streams(s, d):
    return events.log_streams(streams(s, d), 1706000000000, 1706650000000)


@query("estimate_volume_sample", f"""SELECT sample_size, sample_bytes / sample_size AS avg_event_size, estimated_bytes, log_streams,
  CAST(floor(estimated_bytes / (sample_bytes / sample_size)) AS BIGINT) AS estimated_events
FROM (SELECT count(*) AS sample_size, CAST(sum(length(uri)) AS BIGINT) AS sample_bytes FROM (SELECT uri FROM v_logs ORDER BY timestamp, log_id LIMIT 1000)),
  (SELECT CAST(sum(stored_bytes) AS BIGINT) AS estimated_bytes, count(*) AS log_streams FROM ({STREAMS}))""")
def estimate_volume_sample(s, d):
    return events.estimate_volume(v.logs(s, d), streams(s, d), ["timestamp", "log_id"], "uri")


@query("batch_scan_dir", f"SELECT web_acl_id, {N} AS logs, count(CASE WHEN action = 'BLOCK' THEN 1 END) AS blocked, min(timestamp) AS first_time FROM v_norm GROUP BY 1")
def batch_scan_dir(s, d):
    """One folder per ACL is written, every file of the tree is read, and each
    row keeps the file it came from."""
    path = scratch_path(s, "by-acl")
    sinks.write_raw_by_acl(v.raw_logs(s, d), path)
    decoded = raw.decode_lines(raw.scan_lines(s, path, "part-*"))
    logs = normalize.normalize_logs(decoded)
    folder = F.regexp_extract("path", r"web_acl_name=([^/]*)/", 1)
    return logs.groupBy(folder.alias("web_acl_id")).agg(
        metrics.n_rows().alias("logs"), metrics.acted("BLOCK").alias("blocked"), F.min("timestamp").alias("first_time")
    )


@query("scan_many_sources", f"""SELECT 'files' AS source_name, {N} AS found, count(CASE WHEN k % 10 >= 5 THEN 1 END) AS valid, count(CASE WHEN k % 10 < 5 THEN 1 END) AS errors FROM v_logs
UNION ALL SELECT 'exports', {N}, count(*), 0 FROM v_logs""")
def scan_many_sources(s, d):
    found = tables.union_sources({
        "files": raw.decode_any(mixed_rows(s, d).select("value")),
        "exports": raw.decode_exports(export_rows(s, d).select("value")),
    })
    counts = raw.parse_summary(found, "source_name")
    return counts.select("source_name", "found", "valid", (F.col("invalid") + F.col("skipped")).alias("errors"))


def one_acl(s, d) -> DataFrame:
    """All raw logs under one ACL, the most uneven case for a layout by ACL."""
    return v.raw_logs(s, d).withColumn("web_acl_id", F.lit("acl/main"))


@query("scan_raw_parallel", f"SELECT action, {N} AS logs, count(DISTINCT client_ip) AS clients FROM v_norm GROUP BY 1")
def scan_raw_parallel(s, d):
    path = scratch_path(s, "hourly")
    sinks.write_hourly(one_acl(s, d), path, "main", flat_day=False)
    logs = normalize.normalize_logs(raw.decode_lines(raw.scan_lines(s, path, "part-*")))
    return logs.groupBy("action").agg(metrics.n_rows().alias("logs"), F.countDistinct("client_ip").alias("clients"))


@query("drop_duplicate_records", f"SELECT {N} AS rows FROM v_norm")
def drop_duplicate_records(s, d):
    rows = v.raw_logs(s, d).select("value", "log_id")
    twice = rows.unionByName(rows).withColumn("value", F.concat("value", F.col("log_id").cast("string")))
    return tables.drop_duplicate_records(twice).agg(metrics.n_rows().alias("rows"))


# sinks and maintenance
@query("sink_raw_jsonl", f"SELECT 'arn_aws_logs_main' AS folder, {N} AS lines, CAST(sum(CASE WHEN action = 'BLOCK' THEN 1 ELSE 0 END) AS BIGINT) AS blocked FROM v_norm")
def sink_raw_jsonl(s, d):
    rows = v.raw_logs(s, d)
    path = scratch_path(s, "raw")
    sinks.write_raw(rows, path)
    back = normalize.normalize_logs(raw.decode_lines(raw.scan_lines(s, path, "part-*")))
    folder = sinks.safe_name(F.lit("/arn:aws/logs:main/")).alias("folder")
    return back.agg(metrics.n_rows().alias("lines"), metrics.acted("BLOCK").alias("blocked")).select(folder, "lines", "blocked")


@query("sink_raw_by_acl", f"SELECT replace(web_acl_id, ':', '_') AS web_acl_name, {N} AS lines FROM v_logs GROUP BY 1")
def sink_raw_by_acl(s, d):
    path = scratch_path(s, "acl-folders")
    sinks.write_raw_by_acl(v.raw_logs(s, d), path)
    return s.read.text(path).groupBy("web_acl_name").agg(metrics.n_rows().alias("lines"))


@query("sink_parquet", f"SELECT CAST(timestamp AS DATE) AS dt, {N} AS logs, count(DISTINCT client_ip) AS clients, max(timestamp) AS last_time FROM v_traffic GROUP BY 1")
def sink_parquet(s, d):
    path = scratch_path(s, "waf-logs")
    sinks.write_table(v.traffic(s, d), path)
    return s.read.parquet(path).groupBy(F.to_date("timestamp").alias("dt")).agg(
        metrics.n_rows().alias("logs"), F.countDistinct("client_ip").alias("clients"), F.max("timestamp").alias("last_time")
    )


@query("sink_parquet_by_day", f"SELECT CAST(timestamp AS DATE) AS dt, {N} AS logs, count(DISTINCT client_ip) AS clients, max(timestamp) AS last_time FROM v_logs GROUP BY 1")
def sink_parquet_by_day(s, d):
    path = scratch_path(s, "waf-logs-by-day")
    sinks.write_table(v.logs(s, d), path, by_day=True)
    return s.read.parquet(path).groupBy("dt").agg(
        metrics.n_rows().alias("logs"), F.countDistinct("client_ip").alias("clients"), F.max("timestamp").alias("last_time")
    )


@query("sink_hourly_gz", f"""SELECT 'main' AS profile, 'main' AS web_acl, strftime(timestamp, '%Y-%m-%d') AS dt, CAST(strftime(timestamp, '%H') AS INTEGER) AS hh, {N} AS lines
FROM v_logs GROUP BY 1, 2, 3, 4""")
def sink_hourly_gz(s, d):
    path = scratch_path(s, "hourly-gz")
    sinks.write_hourly(one_acl(s, d), path, "main")
    back = s.read.schema("value string, profile string, web_acl string, dt string, hh int").text(path)
    return back.groupBy("profile", "web_acl", "dt", "hh").agg(metrics.n_rows().alias("lines"))


@query("append_logs", "SELECT CAST((SELECT max(event_id) + 1 FROM events) + row_number() OVER (ORDER BY timestamp, log_id) - 1 AS BIGINT) AS log_id, timestamp, uri FROM v_logs")
def append_logs(s, d):
    """The stored table is the logs themselves; the batch is the same logs again."""
    logs = v.logs(s, d)
    batch = logs.select("timestamp", F.col("log_id").alias("source_id"), "uri")
    return append.append_logs(logs, batch, ["timestamp", "source_id"]).select("log_id", "timestamp", "uri")


@query("migrate_acl_ids", f"SELECT web_acl_id, {N} AS logs, count(CASE WHEN k % 3 = 0 THEN 1 END) AS migrated FROM v_logs GROUP BY 1")
def migrate_acl_ids(s, d):
    full = F.concat(F.lit("arn:aws:wafv2:us-east-1:1:regional/webacl/n/"), F.col("web_acl_id"))
    old = v.logs(s, d).withColumn("web_acl_id", F.when(F.col("k") % 3 == 0, full).otherwise(F.col("web_acl_id")))
    return append.migrate_acl_ids(old).groupBy("web_acl_id").agg(metrics.n_rows().alias("logs"), count_when(F.col("migrated")).alias("migrated"))


@query("retention_filter", f"SELECT {N} AS kept, min(timestamp) AS oldest FROM v_logs WHERE timestamp >= TIMESTAMP '2024-01-21 12:00:00'")
def retention_filter(s, d):
    kept = append.retain(v.logs(s, d), datetime(2024, 1, 31, 12), 10)
    return kept.agg(metrics.n_rows().alias("kept"), F.min("timestamp").alias("oldest"))


@query("retain_days", """SELECT 'kept' AS part, CAST(log_id AS BIGINT) AS n FROM v_logs WHERE timestamp >= TIMESTAMP '2024-01-21 12:00:00'
UNION ALL SELECT 'days written again', 1""")
def retain_days(s, d):
    """Days stored, expired and read back. Of the days that stay only that of the boundary
    has files of the second version."""
    path, as_of = scratch_path(s, "days"), datetime(2024, 1, 31, 12)
    store.append_days(v.logs(s, d).select("log_id", "timestamp", "action"), path)
    store.retain_days(s, path, as_of, 10)
    again = F.input_file_name().contains(f"{store.VERSION}=1")
    rows = store.read(s, path).withColumn("again", again)
    days = rows.where("again").agg(F.count_distinct(F.to_date("timestamp")).alias("n"))
    return rows.select(F.lit("kept").alias("part"), F.col("log_id").alias("n")).union(days.select(F.lit("days written again"), "n"))


@query("number_traffic", """SELECT web_acl_id, timestamp, client_ip, CAST(row_number() OVER (PARTITION BY web_acl_id ORDER BY timestamp, client_ip) AS BIGINT) AS position
FROM (SELECT DISTINCT web_acl_id, timestamp, client_ip FROM v_traffic)""")
def number_traffic(s, d):
    rows = v.traffic(s, d).select("web_acl_id", "timestamp", "client_ip").distinct()
    return number_rows(rows, ["timestamp", "client_ip"], "position", ["web_acl_id"])
