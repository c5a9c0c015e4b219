"""Fields of a log record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col


def filled(c) -> Column:
    """Empty text counts as missing."""
    return F.nullif(col(c), F.lit(""))


def first_filled(*cols) -> Column:
    """First value that is neither null nor empty, as the last fallback leaves it."""
    return F.coalesce(*[filled(c) for c in cols[:-1]], col(cols[-1]))


def user_agent(headers) -> Column:
    """Value of the first header named user-agent, in any case."""
    named = F.filter(col(headers), lambda h: F.lower(h["name"]) == "user-agent")
    return F.get(named, F.lit(0))["value"]


def rule_groups_hit(rule_group_list) -> Column:
    """Id, else name, of every rule group that has one."""
    names = F.transform(col(rule_group_list), lambda g: F.coalesce(filled(g["ruleGroupId"]), filled(g["ruleGroupName"])))
    return F.array_compact(F.coalesce(names, F.array().cast("array<string>")))


def list_json(c) -> Column:
    """JSON text of a list, [] when it is absent."""
    return F.coalesce(F.to_json(col(c)), F.lit("[]"))
