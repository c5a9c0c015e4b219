"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import number_within

#: an upper bound on the hash, which is the first 13 hex digits of an MD5
FULL = float(1 << 52)


def _draw(key: Column, shard: int) -> Column:
    """A number in (0, 1) that only the key and the shard decide."""
    digest = F.md5(F.concat_ws(":", F.lit(str(shard)), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / FULL


def rendezvous(key: Column, weights: dict[int, float]) -> Column:
    """The shard with the highest score -weight / ln(draw). Adding a shard moves only
    records that go to it, in proportion to its weight; removing one moves only its own.
    Shards of weight 0 get nothing. Of equal scores the lower shard wins. A null key is a
    key like any other and counts as the empty text."""
    scored = [
        F.struct((F.lit(float(w)) / -F.log(_draw(key, shard))).alias("score"), F.lit(-shard).alias("order"))
        for shard, w in sorted(weights.items())
        if w > 0
    ]
    if not scored:
        raise ValueError("no shard has a weight above 0")
    return (-F.array_max(F.array(*scored)).getField("order")).cast("int")


def assign(df: DataFrame, key: str, weights: dict[int, float], name: str = "shard") -> DataFrame:
    """df with the shard of each row; nothing is shuffled. Repeated rows go together."""
    return df.withColumn(name, rendezvous(F.col(key), weights))


def shard_documents(docs: DataFrame, shards: int = 8, weights: dict[int, float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, moved: where each document
    goes with `shards` shards and where it would go with one more of the mean weight.

    slot numbers the rows of a shard from 0 without gaps, in the order of a digest of
    doc_id, then text_crc32 and size, so reruns agree; rows that repeat in these three get
    neighbouring slots. A null text has size 1 and checksum 0; an empty table gives no
    rows; other columns are ignored."""
    weights = weights or {shard: 1.0 for shard in range(shards)}
    grown = weights | {max(weights) + 1: sum(weights.values()) / len(weights)}
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    rows = assign(assign(rows, "doc_id", weights), "doc_id", grown, "grown_shard")
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    order = [digest, F.col("text_crc32"), F.col("size")]
    numbered = number_within(rows, ["shard"], order, "slot", spread=F.conv(F.substring(digest, 14, 3), 16, 10))
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard",
        (F.col("shard") != F.col("grown_shard")).alias("moved"),
    )
