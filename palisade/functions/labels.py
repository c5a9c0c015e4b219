"""Classifications by fixed, ordered tests. The first test that holds wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col

# Actions, in report order.
ACTIONS = ["BLOCK", "ALLOW", "COUNT", "CAPTCHA", "CHALLENGE"]

# Attack label and the rule-name fragments that give it, in test order.
ATTACKS_BY_RULE = [
    ("SQL Injection", ["sqli", "sql"]),
    ("Cross-Site Scripting", ["xss"]),
    ("Scanner/Reconnaissance", ["scanner", "recon"]),
    ("Bot Traffic", ["bot"]),
    ("Geographic Block", ["geo"]),
    ("Rate Limiting", ["rate"]),
    ("IP Reputation", ["ip", "reputation"]),
    ("File Inclusion", ["rfi", "lfi"]),
    ("Remote Code Execution", ["rce", "command"]),
]
ATTACKS_BY_REQUEST = [
    ("SQL Injection", ["sqli", "sql"]),
    ("Cross-Site Scripting", ["xss"]),
    ("File Inclusion", ["rfi", "lfi"]),
    ("Remote Code Execution", ["rce", "command"]),
    ("Scanner/Reconnaissance", ["scanner", "recon"]),
    ("Bot Traffic", ["bot"]),
    ("Geographic Block", ["geo"]),
    ("Rate Limiting", ["rate"]),
    ("IP Reputation", ["ip"]),
]

# Statement key and rule type, in test order.
RULE_TYPES = [
    ("ManagedRuleGroupStatement", "MANAGED_RULE_GROUP"),
    ("RateBasedStatement", "RATE_BASED"),
    ("RuleGroupReferenceStatement", "RULE_GROUP_REFERENCE"),
    ("GeoMatchStatement", "GEO_MATCH"),
    ("IPSetReferenceStatement", "IP_SET"),
    ("RegexPatternSetReferenceStatement", "REGEX_PATTERN_SET"),
    ("SizeConstraintStatement", "SIZE_CONSTRAINT"),
    ("SqliMatchStatement", "SQLI_MATCH"),
    ("XssMatchStatement", "XSS_MATCH"),
    ("ByteMatchStatement", "BYTE_MATCH"),
    ("AndStatement", "LOGICAL"),
    ("OrStatement", "LOGICAL"),
    ("NotStatement", "LOGICAL"),
]

# Action key of a rule, in test order.
RULE_ACTIONS = ["Allow", "Block", "Count", "Captcha", "Challenge"]


def first_match(tests: list[tuple[Column, object]], default) -> Column:
    """CASE WHEN over (condition, value) pairs."""
    chain = F.when(tests[0][0], tests[0][1])
    for condition, value in tests[1:]:
        chain = chain.when(condition, value)
    return chain.otherwise(default)


def _contains_any(text: Column, fragments: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(f) for f in fragments])


def attack_of_rule(rule_id) -> Column:
    """Label of a terminating rule in the metrics."""
    name = F.lower(col(rule_id))
    return first_match([(_contains_any(name, f), F.lit(label)) for label, f in ATTACKS_BY_RULE], F.lit("Other"))


def attack_of_request(action, rule_id) -> Column:
    """Label of one request; a different test order, and N/A unless blocked."""
    name = F.lower(F.coalesce(col(rule_id), F.lit("")))
    label = first_match([(_contains_any(name, f), F.lit(v)) for v, f in ATTACKS_BY_REQUEST], F.lit("Other"))
    return F.when(col(action).eqNullSafe("BLOCK"), label).otherwise("N/A")


def rule_type(statement_json) -> Column:
    """Rule type from the keys of its JSON statement."""
    keys = F.json_object_keys(col(statement_json))
    tests = [(F.array_contains(keys, key), F.lit(label)) for key, label in RULE_TYPES]
    return first_match(tests, F.lit("CUSTOM"))


def norm_action(action) -> Column:
    return F.coalesce(F.nullif(col(action), F.lit("")), F.lit("UNKNOWN"))


def known_action(action) -> Column:
    return F.coalesce(col(action).isin(ACTIONS), F.lit(False))


def default_action_label(default_action) -> Column:
    """ALLOW or BLOCK for a JSON object, any other text as it is."""
    keys = F.json_object_keys(col(default_action))
    return (
        F.when(keys.isNull(), col(default_action))
        .when(F.array_contains(keys, "Allow"), F.lit("ALLOW"))
        .otherwise("BLOCK")
    )


def rule_action_label(action_json) -> Column:
    """Counted label of a rule action: null for an empty text, UNKNOWN for
    unreadable JSON, OTHER for an object without a known key."""
    text = col(action_json)
    keys = F.json_object_keys(text)
    tests = [(F.array_contains(keys, k), F.lit(k.upper())) for k in RULE_ACTIONS]
    return F.when(F.coalesce(text, F.lit("")) != "", F.when(keys.isNull(), "UNKNOWN").otherwise(first_match(tests, F.lit("OTHER"))))


def rule_action_detail(action_json) -> Column:
    """Listed label of a rule action: the text itself where no key is known."""
    text = col(action_json)
    keys = F.json_object_keys(text)
    return first_match([(F.array_contains(keys, k), F.lit(k.upper())) for k in RULE_ACTIONS], text)


def threat_level(block_rate: Column, blocked: Column) -> Column:
    return first_match(
        [
            ((block_rate > 75) & (blocked > 100), F.lit("CRITICAL")),
            ((block_rate > 50) & (blocked > 50), F.lit("HIGH")),
            ((block_rate > 25) | (blocked > 100), F.lit("MEDIUM")),
        ],
        F.lit("LOW"),
    )


# Report texts per threat level.
THREAT_TEXTS = {
    "CRITICAL": "High volume of blocked traffic - investigate immediately",
    "HIGH": "Significant blocking activity - monitor closely",
    "MEDIUM": "Moderate threat activity detected",
    "LOW": "Low threat activity",
}

# Block rate above which a rule has the status, and its text.
RULE_STATUSES = [
    (80, "HIGHLY EFFECTIVE", "Performing well"),
    (50, "EFFECTIVE", "Good performance"),
    (20, "MODERATE", "Review for optimization"),
]
UNUSED_STATUS = ("UNUSED", "Consider removing or reviewing")
LOW_STATUS = ("LOW", "May need adjustment")


def rule_status(hits: Column, block_rate: Column) -> tuple[Column, Column]:
    def chain(index: int) -> Column:
        tests = [(hits == 0, F.lit(UNUSED_STATUS[index]))]
        tests += [(block_rate > s[0], F.lit(s[1 + index])) for s in RULE_STATUSES]
        return first_match(tests, F.lit(LOW_STATUS[index]))

    return chain(0), chain(1)


def band(value: Column, above: list[tuple[float, str]], default: str) -> Column:
    return first_match([(value > limit, F.lit(name)) for limit, name in above], F.lit(default))


def lookup(c: Column, table: dict[str, str], default: str | None = None) -> Column:
    return first_match([(c == k, F.lit(v)) for k, v in table.items()], F.lit(default))
