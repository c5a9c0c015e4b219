"""Streams over landed files, run to the end of what has landed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, normalize, sinks, store
from ..session import scratch_path
from ..streaming import logs as st
from . import views as v
from .ingest_queries import FIELDS, NORM
from .registry import n_sql, pct2_sql, query

N = "CAST(count(*) AS BIGINT)"


#: what is wrong with a landed line, by the log's k
SKIPPED, TRAILING, BROKEN = 3, 4, 5


def landed(s, d) -> str:
    """Landed lines. Some hold an empty envelope and a record, some a record and trailing
    text, some a record and the beginning of another."""
    path, k, value = scratch_path(s, "landed"), F.col("k") % 10, F.col("value")
    text = (
        F.when(k == SKIPPED, F.concat(F.lit('{"@message":""}'), value)).when(k == TRAILING, F.concat(value, F.lit(" trailing text")))
        .when(k == BROKEN, F.concat(value, F.lit('{"cut": '))).otherwise(value)
    )
    sinks.write_raw(v.raw_logs(s, d).withColumn("value", text).repartition(4), path)
    return path


def stored(df):
    return normalize.normalize_logs(df).select(*FIELDS)


def land(s, d, normalized, order=None) -> str:
    """The folder of a stream that has landed all lines, two files a batch."""
    lines = st.stream_lines(s, landed(s, d), files_per_batch=2, glob="part-*")
    return st.run_to_end(lambda path, state: st.land_logs(lines, path, state, normalized, order), s, "streamed")


@query("stream_logs", NORM)
def stream_logs(s, d):
    return s.read.parquet(f"{land(s, d, stored)}/rows").drop("batch")


@query("stream_rejects", f"""SELECT CASE k % 10 WHEN {SKIPPED} THEN '{{"@message":""}}' WHEN {TRAILING} THEN 'trailing text' ELSE '{{"cut":' END AS value,
  CASE WHEN k % 10 = {SKIPPED} THEN 'skipped' ELSE 'invalid' END AS decode_status, {N} AS rows FROM v_logs WHERE k % 10 IN ({SKIPPED}, {TRAILING}, {BROKEN}) GROUP BY ALL""")
def stream_rejects(s, d):
    rejects = s.read.parquet(f"{land(s, d, stored)}/rejects")
    return rejects.groupBy(F.trim("value").alias("value"), "decode_status").agg(metrics.n_rows().alias("rows"))


@query("stream_counters", f"""SELECT {N} + {n_sql(f"k % 10 IN ({SKIPPED}, {TRAILING}, {BROKEN})")} AS found, {N} AS valid, {n_sql(f"k % 10 IN ({TRAILING}, {BROKEN})")} AS invalid,
  {n_sql(f"k % 10 = {SKIPPED}")} AS skipped FROM v_logs""")
def stream_counters(s, d):
    counters = st.landed_counters(s, land(s, d, stored))
    return counters.agg(*[F.sum(n).alias(n) for n in ("found", "valid", "invalid", "skipped")])


@query("stream_append", """SELECT timestamp, uri, action FROM v_norm UNION ALL SELECT NULL, 'ids without gaps', NULL""")
def stream_append(s, d):
    rows = s.read.parquet(f"{land(s, d, lambda df: normalize.normalize_logs(df).select('timestamp', 'uri', 'action', 'raw_log'), ['timestamp', 'raw_log'])}/rows")
    ids = rows.agg((F.countDistinct("log_id") == F.max("log_id") + 1).alias("whole"), (F.min("log_id") == 0).alias("first"), (F.max("log_id") + 1 == metrics.n_rows()).alias("n"))
    note = F.when(F.col("whole") & F.col("first") & F.col("n"), "ids without gaps").otherwise("gaps")
    return rows.select("timestamp", "uri", "action").union(ids.select(F.lit(None).cast("timestamp"), note, F.lit(None).cast("string")))


CLOSED = f"""SELECT date_trunc('hour', timestamp) AS hour, {N} AS total_requests, {n_sql("action = 'BLOCK'")} AS blocked, {n_sql("action = 'ALLOW'")} AS allowed,
  {pct2_sql(n_sql("action = 'BLOCK'"), 'count(*)')} AS block_rate_percent FROM v_norm WHERE timestamp IS NOT NULL GROUP BY 1
  HAVING hour + INTERVAL 3 HOUR <= (SELECT max(timestamp) FROM v_norm)"""


@query("stream_hourly", CLOSED)
def stream_hourly(s, d):
    """Hours the watermark has passed equal the batch result."""
    source = st.stream_logs(s, landed(s, d), lambda df: normalize.normalize_logs(df).select("timestamp", "action"), glob="part-*")
    path = st.run_to_end(lambda p, state: st.write_available(st.hourly_counts(source), p, state), s, "hourly-stream")
    return s.read.parquet(path)


DAYS = f"""SELECT CAST(timestamp AS DATE) AS date, {N} AS total_requests, {n_sql("action = 'BLOCK'")} AS blocked, {n_sql("action = 'ALLOW'")} AS allowed, count(DISTINCT client_ip) AS unique_ips,
  {pct2_sql(n_sql("action = 'BLOCK'"), 'count(*)')} AS block_rate_percent FROM v_norm WHERE timestamp IS NOT NULL GROUP BY 1
  HAVING date + INTERVAL 26 HOUR <= (SELECT max(timestamp) FROM v_norm)"""


@query("stream_daily", DAYS)
def stream_daily(s, d):
    """Days the watermark has passed equal the batch result, distinct clients too."""
    source = st.stream_logs(s, landed(s, d), lambda df: normalize.normalize_logs(df).select("timestamp", "action", "client_ip"), glob="part-*")
    path = st.run_to_end(lambda p, state: st.write_available(st.daily_counts(source), p, state), s, "daily-stream")
    return s.read.parquet(path)


@query("stream_upsert_config", """SELECT rule_id, web_acl_id, CASE WHEN priority > 25 THEN 'CHANGED' ELSE rule_type END AS rule_type, CASE WHEN priority > 25 THEN 2 ELSE 1 END AS version FROM v_rules""")
def stream_upsert_config(s, d):
    """Two dumps of the rules, the second with changed types, landing in any order."""
    rules = v.rules(s, d).select("rule_id", "web_acl_id", "rule_type", "priority").withColumn("version", F.lit(1))
    changed = rules.where(F.col("priority") > 25).withColumns({"rule_type": F.lit("CHANGED"), "version": F.lit(2)})
    path = scratch_path(s, "dumps")
    rules.unionByName(changed).repartition(3).write.json(path)
    source = s.readStream.schema("rule_id string, web_acl_id string, rule_type string, priority int, version int").option("maxFilesPerTrigger", 1).json(path)
    out = st.run_to_end(lambda p, state: st.upsert_stream(source, p, state, "rule_id", ["version"], buckets=16), s, "rules")
    return store.read(s, out).select("rule_id", "web_acl_id", "rule_type", "version")
