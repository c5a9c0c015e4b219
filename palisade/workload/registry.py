"""Queries and their SQL counterparts, side by side."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import use_utc
from .views import SQL_VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say the same, its counterpart."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(use_utc(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add


def with_views(sql: str) -> str:
    """Prefix the SQL with the views it names, in definition order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in SQL_VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(SQL_VIEWS[name])

    visit(sql)
    ctes = [f"{name} AS ({body.strip()})" for name, body in SQL_VIEWS.items() if name in needed]
    return f"WITH {', '.join(ctes)} {sql.strip()}" if ctes else sql.strip()


def pct2_sql(part: str, whole: str) -> str:
    return f"(CASE WHEN ({whole}) = 0 THEN 0.0 ELSE CAST((({part}) * 20000 + ({whole})) // (2 * ({whole})) AS DOUBLE) / 100.0 END)"


def n_sql(condition: str) -> str:
    return f"CAST(count(CASE WHEN {condition} THEN 1 END) AS BIGINT)"
