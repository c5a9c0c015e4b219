"""Mix sources to target weights.

The words of each source stand behind each other in a random but repeatable order of
documents and are cut into blocks of a fixed length. Output shards draw how many blocks
they take from each source; the draws number the slots of a source, a pseudorandom
permutation of each pass over the source maps slots to blocks, and blocks are joined by
that index."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import write_through
from .base import free_name, number_within, word_array

BLOCK_WORDS = 64
SHARDS = 16
MAX_PASSES = 3
SEED = 20240607
#: constants of the permutation's rounds
ROUNDS = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
#: slots that one task makes from one row
RUN = 1 << 16


def weights_in_order(sources: Iterable[str | None], pattern: tuple[float, ...] = (1, 2, 3)) -> dict[str | None, float]:
    """The pattern's weights, repeated over the sources by code point, null last."""
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: float(pattern[i % len(pattern)]) for i, s in enumerate(ordered)}


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], total: float | None = None, passes: int = MAX_PASSES) -> dict[str | None, float]:
    """Share `total` (all words) by weight; a target stops at `passes` times its source's
    size and the excess is shared again among the others, until none is above."""
    total = float(sum(sizes.values())) if total is None else float(total)
    out: dict[str | None, float] = {}
    while open_ := [s for s in sizes if s not in out]:
        left, weight = total - sum(out.values()), sum(weights[s] for s in open_)
        share = {s: left * weights[s] / weight if weight else 0.0 for s in open_}
        full = [s for s in open_ if share[s] > passes * sizes[s]]
        out |= {s: float(passes * sizes[s]) for s in full} or share
    return out


def draw_counts(budget: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (column) that each shard (row) takes. Each shard is a
    multinomial draw with the sources' remaining budgets as weights; what a draw takes
    beyond a budget is drawn again, so that the columns add up to the budgets."""
    rng, left = np.random.default_rng(seed), budget.astype(np.int64).copy()
    total, out = int(left.sum()), np.zeros((shards, len(left)), np.int64)
    for k in range(shards):
        want = total * (k + 1) // shards - total * k // shards
        while want > 0:
            took = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[k] += took
            left -= took
            want -= int(took.sum())
    return out


def permute(index: np.ndarray, size: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 for each seed: four Feistel rounds on the
    next larger power of four, repeated for values that fall outside."""
    half = np.ceil(np.log2(np.maximum(size, 2)) / 2).astype(np.uint64)
    half = np.where((np.uint64(1) << (half * np.uint64(2))) < size.astype(np.uint64), half + np.uint64(1), half)
    mask = (np.uint64(1) << half) - np.uint64(1)
    value, out = index.astype(np.uint64), np.zeros(len(index), np.uint64)
    todo = np.arange(len(index))
    while len(todo):
        h, m, s = half[todo], mask[todo], seed[todo].astype(np.uint64)
        left, right = value[todo] >> h, value[todo] & m
        for r in range(4):
            x = (right + s * np.uint64(0x9E3779B97F4A7C15) + ROUNDS[r]) * np.uint64(0xFF51AFD7ED558CCD)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
            left, right = right, left ^ ((x >> np.uint64(29)) & m)
        value[todo] = (left << h) | right
        inside = value[todo] < size[todo].astype(np.uint64)
        out[todo[inside]] = value[todo[inside]]
        todo = todo[~inside]
    return out.astype(np.int64)


def block_of_slot(index: pd.Series, size: pd.Series, seed: pd.Series) -> pd.Series:
    return pd.Series(permute(index.to_numpy(), size.to_numpy(), seed.to_numpy()))


def pack(rows: DataFrame, order: list[Column], buckets: int = 4096) -> DataFrame:
    """rows (with source and size) and `start`: how many words of the source stand before
    the row. A source of any share of the rows is numbered in parts."""
    return number_within(rows, ["source"], order, "start", buckets, F.col("size"))


def plan_mix(packed: DataFrame, pattern=(1, 2, 3), block: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(sources, slots). sources: source, source_size, target, blocks. slots: source,
    shard, pass, block; one row for each block that a shard takes. Slots grow with the
    corpus though Spark expects them to be as few as the sources, so joins with them ask
    for a merge and never broadcast them. Only the sources' sizes
    come to the driver. Whole passes over a source take every block of it."""
    spark = packed.sparkSession
    found = {r["source"]: int(r["n"] or 0) for r in packed.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    goal = targets(found, weights_in_order(found, pattern))
    names = sorted(found, key=lambda s: (s is None, s or ""))
    blocks = np.array([-(-found[s] // block) for s in names], np.int64)
    budget = np.zeros(len(names), np.int64)
    for i, s in enumerate(names):
        if found[s]:
            whole = min(int(goal[s] // found[s]), MAX_PASSES)
            budget[i] = whole * blocks[i] + (round((goal[s] - whole * found[s]) / block) if whole < MAX_PASSES else 0)
    ends = np.cumsum(draw_counts(budget, shards, seed), axis=0)
    sources = spark.createDataFrame(
        [(s, found[s], float(goal[s]), int(blocks[i]), int(budget[i]), i, ends[:, i].tolist()) for i, s in enumerate(names)],
        "source string, source_size bigint, target double, blocks bigint, budget bigint, number int, ends array<bigint>",
    )
    runs = sources.where("budget > 0").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("budget") - 1) / RUN))))
    spread = runs.repartition(spark.sparkContext.defaultParallelism, "number", "run")
    slots = spread.withColumn("slot", F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("budget"), (F.col("run") + 1) * RUN) - 1)))
    slots = slots.withColumns({"pass": F.floor(F.col("slot") / F.col("blocks")), "shard": F.size(F.filter("ends", lambda e: e <= F.col("slot")))})
    at = F.pandas_udf(block_of_slot, LongType())(F.col("slot") - F.col("pass") * F.col("blocks"), F.col("blocks"), F.col("number") * 1009 + F.col("pass") + seed)
    return sources.select("source", "source_size", "target", "blocks"), slots.select("source", "shard", "pass", at.alias("block"))


def pieces(packed: DataFrame, keys: list[str], block: int = BLOCK_WORDS) -> DataFrame:
    """keys, source, block and the words [first, first + n) of the row in that block."""
    start, end = F.col("start"), F.col("start") + F.col("size")
    cut = packed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(start / block), F.floor((end - 1) / block))))
    low, high = F.greatest(start, F.col("block") * block), F.least(end, (F.col("block") + 1) * block)
    return cut.select(*keys, "source", "block", (low - start).alias("first"), (high - low).alias("n"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document.

    Null text has size 0 and takes nothing; a null source is a source of its own; repeated
    rows count each; an empty table gives no rows; other columns are ignored. The order of
    documents, the draws and the permutations come from hashes and a fixed seed."""
    rows = docs.select("doc_id", "source", F.size(word_array(F.col("text"))).cast("long").alias("size"))
    packed = write_through(pack(rows, [F.xxhash64("doc_id", F.lit(SEED)), F.col("doc_id"), F.col("size")]), "mix-packed")
    sources, slots = plan_mix(packed)
    times = slots.groupBy("source", "block").agg(F.count("*").alias("times"))
    cut = pieces(packed, ["doc_id", "size", "start"]).alias("p")
    same = F.col("p.source").eqNullSafe(F.col("t.source")) & (F.col("p.block") == F.col("t.block"))
    joined = cut.join(times.hint("merge").alias("t"), same, "left")
    taken = joined.groupBy("p.source", "p.start", "p.doc_id", "p.size").agg(F.sum(F.col("p.n") * F.coalesce("t.times", F.lit(0))).alias("taken"))
    empty = packed.where("size = 0").select("source", "start", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    every = taken.unionByName(empty).alias("d")
    out = every.join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")), "left")
    return out.select("d.doc_id", "d.size", "s.source_size", "s.target", F.col("d.taken").cast("long").alias("taken"), F.col("d.source").alias("source"))


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The mix itself, in the columns of docs: one row for each document and pass that
    takes any of it. A document taken whole keeps its text; of others the words taken
    stay, in their order, with single spaces between them. n_chars, if there, follows the
    text. Documents of which nothing is taken go, and null and empty texts with them; a
    null source is a source of its own; an empty table gives no rows.

    Rows are numbered and drawn by a key of their columns and their size, and texts, of any
    length, are shuffled once, to what is drawn of them. Rows repeated in all columns are
    drawn each; one of them stands for the texts of all."""
    names, k = docs.columns, free_name(docs, "__mix_")
    plain = [f"`{f.name}`" for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    keyed = docs.withColumn(f"{k}key", F.xxhash64(*[F.col(c) for c in plain]))
    narrow = keyed.select(F.col(f"{k}key").alias("key"), "doc_id", "source", F.size(word_array(F.col("text"))).cast("long").alias("size"))
    packed = write_through(pack(narrow, [F.xxhash64("doc_id", F.lit(SEED)), F.col("doc_id"), F.col("key"), F.col("size")]).drop("doc_id"), "mix-packed")
    _, slots = plan_mix(packed.select("source", "size"))
    cut = pieces(packed, ["key", "start", "size"]).alias("p")
    same = F.col("p.source").eqNullSafe(F.col("t.source")) & (F.col("p.block") == F.col("t.block"))
    drawn = cut.join(slots.hint("merge").alias("t"), same).select("p.key", "p.source", "p.start", "p.size", "t.pass", F.struct("p.first", "p.n").alias("part"))
    parts = drawn.groupBy("key", "source", "start", "size", "pass").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    repeats = packed.groupBy("key").agg((F.count("*") > 1).alias("repeated"))
    whole = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["n"]) == F.col("size")
    takes = parts.join(repeats, "key").select("key", F.when(~whole, F.col("parts")).alias("parts"), "repeated")
    takes = write_through(takes.withColumnsRenamed({c: f"{k}{c}" for c in ("key", "parts", "repeated")}), "mix-drawn")
    again = takes.where(f"{k}repeated")
    once = keyed.join(again.select(f"{k}key").distinct(), f"{k}key", "left_semi").dropDuplicates([f"{k}key"])
    joined = keyed.join(takes.where(f"not {k}repeated"), f"{k}key").unionByName(once.join(again, f"{k}key"))
    words = word_array(F.col("text"))
    some = F.array_join(F.flatten(F.transform(f"{k}parts", lambda x: F.slice(words, (x["first"] + 1).cast("int"), x["n"].cast("int")))), " ")
    taken = joined.withColumn(f"{k}text", F.when(F.col(f"{k}parts").isNull(), F.col("text")).otherwise(some))
    made = {"text": F.col(f"{k}text"), "n_chars": F.length(f"{k}text").cast(docs.schema["n_chars"].dataType) if "n_chars" in names else None}
    return taken.select(*[(made[c] if c in made else F.col(f"`{c}`")).alias(c) for c in names])
