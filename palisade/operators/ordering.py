"""Row numbers over whole tables without sorting them, or one hot key, in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_through


def number_rows(df: DataFrame, order: list[str], name: str, keys: list[str] | None = None, start=1) -> DataFrame:
    """Exact consecutive numbers in `order`, which must be unique, within each
    combination of `keys`.

    Rows are range-partitioned by keys and order, so a hot key spreads over many
    partitions, and written once so that partition numbers cannot change when a
    task is repeated. Each partition is then numbered alone, on top of the count
    of rows its keys have in earlier partitions."""
    keys = keys or []
    ranged = df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    placed = write_through(ranged, "ordered")
    sizes = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("_p"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
    )
    here = Window.partitionBy("_part", *keys).orderBy(*order)
    condition = F.col("_part") == F.col("_p")
    for k in keys:
        condition &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    number = F.col("_before") + F.col("_here") - 1 + start
    return (
        placed.withColumn("_here", F.row_number().over(here))
        .join(offsets, condition)
        .withColumn(name, number.cast("bigint"))
        .select(*df.columns, name)
    )
