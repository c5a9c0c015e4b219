"""Decoded records to the wide log table, in one projection without UDFs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import arns, labels, records, times


def field(path: str, kind: str = "string", record: str = "record") -> Column:
    return F.try_variant_get(F.col(record), path, kind)


def request_field(name: str) -> Column:
    """Value inside httpRequest, else at the top level; empty counts as missing."""
    return records.first_filled(field(f"$.httpRequest.{name}"), field(f"$.{name}"))


def normalize_logs(decoded: DataFrame, default_time: Column | None = None, as_of: Column | None = None) -> DataFrame:
    """One row per valid record. Rows whose time is missing or unreadable keep a
    null time (see `split_rejects`) unless a default is given. With a moment, the time of
    load is a column created_at.

    The fields are taken out in two struct casts, one per level, with scalars as
    text: text takes any value, so one odd field cannot void its neighbours."""
    kept = [c for c in ("source", "path") if c in decoded.columns]
    valid = decoded.where(F.col("decode_status") == "valid")
    top = valid.select(
        field("$", schemas.RECORD).alias("t"), field("$.webAclId").alias("acl_id"), field("$.webAclName").alias("acl_name"),
        F.col("record_text").alias("raw_log"), *kept,
    )
    both = top.withColumn("h", field("$", schemas.REQUEST, "t.httpRequest"))
    requested = lambda name: records.first_filled(f"h.{name}", f"t.{name}")
    when = times.normalize_timestamp("t.timestamp")
    columns = {
        "timestamp": when if default_time is None else F.coalesce(when, default_time),
        "web_acl_id": arns.acl_id(records.first_filled("t.webaclId", "acl_id")),
        "web_acl_name": records.first_filled("t.webaclName", "acl_name"),
        "action": labels.norm_action("t.action"),
        "client_ip": requested("clientIp"),
        "country": requested("country"),
        "uri": requested("uri"),
        "http_method": requested("httpMethod"),
        "http_version": requested("httpVersion"),
        "http_status": F.col("t.httpStatus").try_cast("int"),
        "terminating_rule_id": F.col("t.terminatingRuleId"),
        "terminating_rule_type": F.col("t.terminatingRuleType"),
        "terminating_rule_match_details": present("t.terminatingRuleMatchDetails"),
        "rule_group_list": field("$", schemas.RULE_GROUPS, "t.ruleGroupList"),
        "rate_based_rule_list": present("t.rateBasedRuleList"),
        "non_terminating_matching_rules": present("t.nonTerminatingMatchingRules"),
        "labels": present("t.labels"),
        "ja3_fingerprint": F.col("t.ja3Fingerprint"),
        "ja4_fingerprint": F.col("t.ja4Fingerprint"),
        "request_headers": field("$", schemas.HEADERS, "h.headers"),
        "response_code_sent": F.col("t.responseCodeSent").try_cast("int"),
        "http_source_name": F.col("t.httpSourceName"),
        "http_source_id": F.col("t.httpSourceId"),
        "raw_log": F.col("raw_log"),
    }
    named = both.select(*[c.alias(n) for n, c in columns.items()], *kept)
    return named.withColumn("user_agent", records.user_agent("request_headers")).select(*schemas.LOG_COLUMNS, *kept, *([] if as_of is None else [as_of.alias("created_at")]))


def present(name: str) -> Column:
    """A nested value; a JSON null counts as absent."""
    return F.when(~F.is_variant_null(F.col(name)), F.col(name))


def split_rejects(logs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be stored, and rows without a usable time."""
    return logs.where(F.col("timestamp").isNotNull()), logs.where(F.col("timestamp").isNull())


def nested_to_json(logs: DataFrame) -> DataFrame:
    """The same table with nested columns as JSON text: absent lists become [],
    an absent match detail stays null."""
    changed = {c: records.list_json(c) for c in schemas.NESTED_LISTS if c in logs.columns}
    if "terminating_rule_match_details" in logs.columns:
        changed["terminating_rule_match_details"] = F.to_json("terminating_rule_match_details")
    return logs.withColumns(changed)


def rule_group_hits(logs: DataFrame) -> DataFrame:
    """How often each rule group was evaluated."""
    named = logs.select(F.explode(records.rule_groups_hit("rule_group_list")).alias("rule_group"))
    return named.groupBy("rule_group").agg(F.count(F.lit(1)).alias("hits"))
