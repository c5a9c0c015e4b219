"""Record and key checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import labels
from ..functions.numbers import col


def problems(required: dict[str, Column | str], action: Column | str) -> Column:
    """Texts naming every missing field and an action outside the known ones."""
    missing = [F.when(col(c).isNull(), F.lit(f"missing:{name}")) for name, c in required.items()]
    odd = F.when(col(action).isNotNull() & (col(action) != "") & ~labels.known_action(action), F.lit("invalid:action"))
    return F.array_compact(F.array(*missing, odd))


def validate_logs(df: DataFrame, required: dict[str, Column | str], action: Column | str) -> DataFrame:
    """Adds `reasons` (joined text) and `is_valid`."""
    found = problems(required, action)
    return df.withColumn("reasons", F.array_join(found, ";")).withColumn("is_valid", F.col("reasons") == "")


def required_of_record(fields: list[str] = schemas.REQUIRED_FIELDS, record: str = "record") -> dict[str, Column]:
    """Required fields of a decoded record, dotted names reaching inside."""
    return {f: F.nullif(F.try_variant_get(F.col(record), f"$.{f}", "string"), F.lit("")) if "." in f
            else F.try_variant_get(F.col(record), f"$.{f}", "string") for f in fields}


def duplicate_keys(table: DataFrame, key: str) -> DataFrame:
    return table.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def orphan_rows(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose key is null or unknown to the parent table."""
    return child.join(parent.select(key).distinct(), key, "left_anti")


def key_report(tables: dict[str, tuple[DataFrame, str]], parents: dict[str, tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """One row per check: duplicated keys per table, rows without parent per reference."""
    checks = [
        duplicate_keys(df, key).agg(F.count(F.lit(1)).alias("violations")).select(F.lit(f"{name}.{key} unique").alias("check"), "violations")
        for name, (df, key) in tables.items()
    ]
    for name, (child, parent, key) in parents.items():
        # counting per key first keeps a hot key out of the join
        per_key = child.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
        lost = orphan_rows(per_key, parent, key).agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("violations"))
        checks.append(lost.select(F.lit(f"{name}.{key} known").alias("check"), "violations"))
    report = checks[0]
    for check in checks[1:]:
        report = report.unionByName(check)
    return report
