"""Stored tables that change by parts.

A table is a folder of parts, each written once under the version that wrote it, and of
manifests: the manifest of a version lists every part of the table with the version whose
files hold it. A change writes new files for the parts it touches and then a manifest of one
file, whose appearance is the commit: readers under way keep the files of the version they
have begun with, and a change that is run again writes the same version again. Files that no
kept manifest names are expired in a step of their own.

Keyed tables have hash buckets of the key as parts, logs have days.
"""

from __future__ import annotations

import json
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import StructType

from .sinks import balanced
from .upsert import latest_per_key, upsert

PART, VERSION = "_part", "_version"
MANIFEST = "part string, files bigint, row_schema string"


def _folder(path: str, version: int, part: str) -> str:
    return f"{path}/data/{VERSION}={version}/{PART}={part}"


def _hadoop(spark: SparkSession, path: str):
    """A path of whatever file system it names, and that file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions with a manifest, oldest first. What a failed write left has none."""
    at, fs = _hadoop(spark, f"{path}/manifest")
    if not fs.exists(at):
        return []
    names = [f.getPath() for f in fs.listStatus(at)]
    return sorted(int(p.getName()) for p in names if p.getName().isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[dict[str, int], str | None]:
    """The version whose files hold each part, and the schema of the rows. A manifest has as
    many rows as the table has parts: the number of buckets, or of days."""
    if version is None:
        version = max(versions(spark, path), default=-1)
    if version < 0:
        return {}, None
    rows = spark.read.schema(MANIFEST).json(f"{path}/manifest/{version}").collect()
    return {r["part"]: r["files"] for r in rows if r["part"] is not None}, next((r["row_schema"] for r in rows), None)


def _commit(spark: SparkSession, path: str, version: int, parts: dict[str, int], row_schema: str) -> None:
    rows = [(p, v, row_schema) for p, v in sorted(parts.items())] or [(None, None, row_schema)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest/{version}")


def _read(spark: SparkSession, path: str, parts: dict[str, int], row_schema: str) -> DataFrame:
    kind = StructType.fromJson(json.loads(row_schema))
    folders = [_folder(path, v, p) for p, v in sorted(parts.items())]
    return spark.read.schema(kind).parquet(*folders) if folders else spark.createDataFrame([], kind)


def read(spark: SparkSession, path: str, version: int | None = None, only: list[str] | None = None) -> DataFrame:
    """The table as of a version, the latest if none is named; `only` some of its parts."""
    parts, row_schema = manifest(spark, path, version)
    if row_schema is None:
        raise ValueError(f"no table at {path}")
    return _read(spark, path, {p: v for p, v in parts.items() if only is None or p in only}, row_schema)


def replace_parts(spark: SparkSession, path: str, version: int, rows: DataFrame, part: Column, touched: list[str], before: dict[str, int]) -> None:
    """Write the rows of the touched parts and commit the version. A touched part without
    rows leaves the table."""
    target = f"{path}/data/{VERSION}={version}"
    keyed = rows.withColumn(PART, part.cast("string"))
    balanced(keyed, PART).write.mode("overwrite").partitionBy(PART).parquet(target)
    at, fs = _hadoop(spark, target)
    written = {f.getPath().getName().removeprefix(f"{PART}=") for f in fs.listStatus(at) if f.isDirectory()}
    kept = {p: v for p, v in before.items() if p not in touched}
    _commit(spark, path, version, kept | {p: version for p in written}, rows.schema.json())


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def merge(
    batch: DataFrame, path: str, key: str, order: list[str] | None = None, keep_first: list[str] | None = None,
    version: int | None = None, buckets: int = 64, within: list[str] | None = None,
) -> int:
    """Insert or update by key and give the version. Only buckets with a key of the batch
    are read and written again.

    Of the rows of a key in the batch the last in `within` counts; these columns are not
    stored. It takes the place of a stored row, unless `order` names stored columns by which
    that one is later. Columns in `keep_first` keep their stored value. The number of buckets
    must stay what it was at first. Rows without a key are one key."""
    spark = batch.sparkSession
    version = max(versions(spark, path), default=-1) + 1 if version is None else version
    before, row_schema = manifest(spark, path, version - 1)
    part = bucket(key, buckets)
    touched = [str(r[0]) for r in batch.select(part.alias("b")).distinct().collect()]
    known = {p: v for p, v in before.items() if p in touched}
    new = latest_per_key(batch, key, [*(order or []), *within]).drop(*within) if within else batch
    old = _read(spark, path, known, row_schema).select(*new.columns) if known else None
    if order:
        rows = upsert(old, new, key, order, keep_first)
    else:
        turn = lambda df, n: df.withColumn("_turn", F.lit(n))
        rows = latest_per_key(turn(new, 1) if old is None else turn(old, 0).unionByName(turn(new, 1)), key, ["_turn"], keep_first).drop("_turn")
    replace_parts(spark, path, version, rows, part, touched, before)
    return version


def day(time: str = "timestamp") -> Column:
    """The part of a row of logs; rows without a time are a part that never expires."""
    return F.coalesce(F.date_format(time, "yyyy-MM-dd"), F.lit("undated"))


def append_days(logs: DataFrame, path: str, version: int | None = None, days: DataFrame | None = None) -> int:
    """Store logs by day. Days that are there already are read and written again with the
    new rows; others stay as they are. `days` has the timestamps of the rows, where they can
    be had with less work than the rows themselves."""
    spark = logs.sparkSession
    version = max(versions(spark, path), default=-1) + 1 if version is None else version
    before, row_schema = manifest(spark, path, version - 1)
    touched = [r[0] for r in (logs if days is None else days).select(day().alias("d")).distinct().collect()]
    known = {p: v for p, v in before.items() if p in touched}
    rows = _read(spark, path, known, row_schema).unionByName(logs) if known else logs
    replace_parts(spark, path, version, rows, day(), touched, before)
    return version


def retain_days(spark: SparkSession, path: str, as_of: datetime, days: int, version: int | None = None) -> int:
    """Let rows older than `days` days go; zero or less keeps all. Older days leave the
    manifest without being read, and only the day of the boundary is written again."""
    last = max(versions(spark, path), default=-1)
    if days <= 0:
        return last
    version = last + 1 if version is None else version
    before, row_schema = manifest(spark, path, version - 1)
    if row_schema is None:
        raise ValueError(f"no table at {path}")
    cutoff = as_of - timedelta(days=days)
    edge = f"{cutoff:%Y-%m-%d}"
    kept = {p: v for p, v in before.items() if p > edge}
    if edge not in before:
        _commit(spark, path, version, kept, row_schema)
        return version
    rest = _read(spark, path, {edge: before[edge]}, row_schema).where(F.col("timestamp") >= F.lit(cutoff))
    replace_parts(spark, path, version, rest, day(), [edge], kept | {edge: before[edge]})
    return version


def expire(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete manifests older than the last `keep`, and the files that none of those names.
    Readers of older versions must be done. Gives the folders deleted."""
    all_versions = versions(spark, path)
    named = {_folder(path, v, p) for n in all_versions[-keep:] for p, v in manifest(spark, path, n)[0].items()}
    gone = []
    at, fs = _hadoop(spark, f"{path}/data")
    for version in fs.listStatus(at):
        number = int(version.getPath().getName().removeprefix(f"{VERSION}="))
        if number > all_versions[-1]:
            continue  # a change under way
        for part in fs.listStatus(version.getPath()):
            folder = _folder(path, number, part.getPath().getName().removeprefix(f"{PART}="))
            if part.isDirectory() and folder not in named:
                fs.delete(part.getPath(), True)
                gone.append(folder)
    for old in all_versions[:-keep]:
        fs.delete(_hadoop(spark, f"{path}/manifest/{old}")[0], True)
    return gone
