"""Connected components of links that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_through


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node that each node of a link reaches. Every round
    takes the smallest label among a node's neighbours and then the label's own label, so
    rounds grow with the logarithm of the longest way. Each round is written to the shared
    folder, so that a lost executor costs no earlier round."""
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).union(links.select(F.col(b).alias("node"), F.col(a).alias("other"))).where("node <> other").distinct()
    edges = write_through(both, "links")
    labels = write_through(edges.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("other"), F.col("component").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        step = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        far = step.select(F.col("node").alias("component"), F.col("component").alias("far"))
        jumped = step.join(far, "component", "left").select("node", F.least("component", F.coalesce("far", "component")).alias("component"), "old")
        new = write_through(jumped, "labels")
        if new.where("component <> old").isEmpty():
            return new.select("node", "component")
        labels = new.select("node", "component")
