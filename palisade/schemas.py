"""Column lists and types of the five tables."""

from __future__ import annotations

HEADERS = "array<struct<name:string,value:string>>"
RULE_GROUPS = "array<struct<ruleGroupId:string,ruleGroupName:string>>"

# Field names of a log record and of the request inside it. Scalars
# are read as text, nested values as they are.
RECORD = "struct<" + ",".join(
    [f"{n}:string" for n in (
        "timestamp", "webaclId", "webaclName", "action", "clientIp", "country", "uri", "httpMethod", "httpVersion", "httpStatus",
        "terminatingRuleId", "terminatingRuleType", "ja3Fingerprint", "ja4Fingerprint", "responseCodeSent", "httpSourceName", "httpSourceId",
    )]
    + [f"{n}:variant" for n in (
        "httpRequest", "terminatingRuleMatchDetails", "ruleGroupList", "rateBasedRuleList", "nonTerminatingMatchingRules", "labels",
    )]
) + ">"
REQUEST = "struct<clientIp:string,country:string,uri:string,httpMethod:string,httpVersion:string,headers:variant>"

# Fields a log record must have, and those that hold nested JSON.
REQUIRED_FIELDS = ["timestamp", "action", "clientIp", "country", "uri", "httpMethod", "httpVersion", "httpStatus"]
NESTED_LISTS = ["rule_group_list", "rate_based_rule_list", "non_terminating_matching_rules", "labels", "request_headers"]

LOG_COLUMNS = [
    "timestamp", "web_acl_id", "web_acl_name", "action", "client_ip", "country", "uri", "http_method",
    "http_version", "http_status", "terminating_rule_id", "terminating_rule_type",
    "terminating_rule_match_details", "rule_group_list", "rate_based_rule_list",
    "non_terminating_matching_rules", "labels", "ja3_fingerprint", "ja4_fingerprint", "user_agent",
    "request_headers", "response_code_sent", "http_source_name", "http_source_id", "raw_log",
]

# One element of a configuration dump, as the cloud API prints it.
ACL_CONFIG = (
    "Id string, Name string, ARN string, Capacity bigint, DefaultAction string, Description string, "
    "VisibilityConfig string, ManagedByFirewallManager boolean, "
    "Rules array<struct<Name:string,Priority:int,Action:string,Statement:string,VisibilityConfig:string>>"
)
