"""What several operators of this package share: whole-text words, numbering of rows,
Arrow batches of bounded size, and word hashes over a batch of texts."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import write_through

#: what separates words: the space and the five control characters from tab to return
SPACE = r"[\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Give up the shuffle files of frames that are gone: Spark deletes them once the
    driver's collectors find that nothing refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settle(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back, and the shuffle files behind it given up."""
    out = write_through(df, label)
    del df
    release(out.sparkSession)
    return out


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of df begins with it."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def word_array(text: Column) -> Column:
    """All words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


#: rows and bytes of an Arrow batch; a row is never split
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """fn over Arrow batches bounded in rows and bytes."""
    bound_batches(df.sparkSession)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema)


def number_within(df: DataFrame, group: list[str], order: list[Column], name: str, buckets: int = 256, weight: Column | None = None, spread: Column | None = None) -> DataFrame:
    """Number the rows of each group from 0 in the order (spread, *order), where the
    spread is a hash of the order columns unless one is given; with a weight, give each row the sum of the
    weights before it. A group of any size is dealt over `buckets` parts: each part is
    added up, the few sums are accumulated, and rows are numbered inside their part."""
    part = F.pmod(F.xxhash64(*order), F.lit(buckets)) if spread is None else spread
    spread = df.withColumns({"__spread": part.cast("int"), "__weight": F.lit(1) if weight is None else weight})
    sums = spread.groupBy(*group, "__spread").agg(F.sum("__weight").alias("__n"))
    to_last = (Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("__spread").rowsBetween(*to_last)
    starts = sums.select(*group, "__spread", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*group, "__spread").orderBy(*order).rowsBetween(*to_last)
    ranked = spread.withColumn("__rank", F.coalesce(F.sum("__weight").over(inside), F.lit(0)))
    same = reduce(and_, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*group, "__spread"]])
    joined = ranked.alias("l").join(starts.alias("r"), same, "left")
    return joined.select(*[F.col(f"l.`{c}`") for c in df.columns], (F.col("r.__start") + F.col("l.__rank")).cast("long").alias(name))


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the finaliser of a public 64-bit hash)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: one random value for each byte, and odd multipliers; a seed makes them the same everywhere
_RANDOM = np.random.default_rng(20240607)
BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
PLACE = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), STEP)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a batch behind each other, and where each begins and the
    last ends; null counts as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word of a batch, and for each text its first word's index
    (one more entry than texts). Words never cross texts."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~_IS_SPACE[data]
    edges = np.zeros(len(data) + 1, bool)
    edges[offsets] = True
    edges[-1:] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edges[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | edges[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: bytes that are hashed at once; a longer span is hashed alone
SLICE = 1 << 19


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """A 64-bit hash of each span of bytes. Spans are disjoint, in order and not empty."""
    lengths = ends - starts
    through = np.cumsum(lengths)
    out = np.zeros(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        done = int(through[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(through, done + SLICE, side="right")))
        n = lengths[low:high]
        first = through[low:high] - n - done
        place = np.arange(int(through[high - 1]) - done) - np.repeat(first, n)
        value = table[data[np.repeat(starts[low:high], n) + place]] * powers(int(n.max()))[place]
        out[low:high] = np.add.reduceat(value, first) + n.astype(np.uint64)
        low = high
    return mix64(out)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` word hashes; runs may cross texts."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += words[k : k + n] * PLACE[k]
    return mix64(total)


#: a bit filter has so many bits whatever goes into it: 2 MB
FILTER_BITS = 24


def bit_filter(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A filter over a column of 64-bit hashes: a bit for each value of their first `bits`
    bits. It comes to the driver as 1024 rows at most. What does not pass is not among the
    keys; the more keys there are, the more else passes."""
    part = bits - 10
    top = F.shiftrightunsigned(key, 64 - bits)
    set_bits = keys.select(F.shiftright(top, part).cast("int").alias("part"), (top % (1 << part)).cast("int").alias("bit")).distinct()
    out = np.zeros((1 << 10, 1 << part), bool)
    # each partition is a job of its own there, so there are few
    for r in set_bits.groupBy("part").agg(F.collect_set("bit").alias("bits")).coalesce(8).toLocalIterator():
        out[r["part"], r["bits"]] = True
    return np.packbits(out.reshape(-1), bitorder="little")


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    top = hashes.view(np.uint64) >> np.uint64(64 - 3 - (len(bits).bit_length() - 1))
    return ((bits[(top >> np.uint64(3)).astype(np.int64)] >> (top & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
