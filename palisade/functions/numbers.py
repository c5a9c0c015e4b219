"""Percentages and number texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def int_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def pct2(part, whole) -> Column:
    """part / whole as a percentage with two decimals, 0 for an empty whole.
    Integer arithmetic rounds half up, the same in every engine."""
    a, b = col(part).cast("bigint"), col(whole).cast("bigint")
    return F.coalesce(int_div(a * 20000 + b, b * 2).cast("double") / F.lit(100.0), F.lit(0.0))


def share(part, whole) -> Column:
    """The unrounded percentage, used by threshold rules."""
    a, b = col(part).cast("double"), col(whole).cast("double")
    return F.coalesce(F.try_divide(a, b) * 100.0, F.lit(0.0))


def count_when(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def thousands(c) -> Column:
    return F.format_number(col(c), 0)


def percent_text(c, decimals: int) -> Column:
    return F.format_string(f"%.{decimals}f%%", col(c).cast("double"))


def pct1_text(part, whole) -> Column:
    """The percentage with one decimal and a percent sign, from the counts."""
    a, b = col(part).cast("bigint"), col(whole).cast("bigint")
    tenths = F.coalesce(int_div(a * 2000 + b, b * 2), F.lit(0).cast("bigint"))
    return F.format_string("%d.%d%%", int_div(tenths, F.lit(10).cast("bigint")), F.pmod(tenths, F.lit(10).cast("bigint")))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)
