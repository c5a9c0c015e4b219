"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def chosen_master(cores: str = "*") -> str | None:
    """The master to set, or None where a submit command, a running session or the
    arguments of the launcher have named one already. SPARK_MASTER goes before a local
    master."""
    launched = "PYSPARK_GATEWAY_PORT" in os.environ or "--master" in os.environ.get("PYSPARK_SUBMIT_ARGS", "")
    if launched or SparkContext._active_spark_context is not None:
        return None
    return os.environ.get("SPARK_MASTER", f"local[{cores}]")


def build_session(app_name: str = "palisade", cores: str = "*", **conf) -> SparkSession:
    """A session with the settings every operator expects. On a cluster the
    master, memory and shuffle partitions come from the submit command."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        # a run of many queries keeps its compiled stages
        .config("spark.sql.codegen.cache.maxEntries", "2000")
    )
    if master := chosen_master(cores):
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Hours, days and naive timestamps are UTC in every query."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it. A temporary
    folder is used only by a local master with nothing configured."""
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_CONF, None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="palisade-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_through(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back. This cuts lineage in
    a way that outlives executors and keeps column pruning for later reads."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
