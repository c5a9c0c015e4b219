"""What each filter of a chain removes, for every order of the filters.

Documents are reduced to counts by part and mask, the set of filters they fail. In a given
order a document goes at the first filter of its mask. The orders that begin alike are
neighbours in lexicographic order, so the orders in which a mask goes at a given step by a
given filter are intervals of ranks: its count is added where an interval begins and taken
off where it ends, and a running sum over the ranks gives every order's removals."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_through
from .base import let, word_array

FILTERS = "ABCDE"
MIN_WORDS = 200
#: percent of distinct words, and of capital letters, at which B and C begin to fail
DISTINCT_PERCENT, CAPITAL_PERCENT = 50, 3
SYMBOLS = "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def rank(prefix: str) -> int:
    """The Lehmer rank of the first order that begins with the prefix: each letter counts
    the smaller ones that are not used before it, in factorial digits."""
    digits = [sum(other < x and other not in prefix[:i] for other in FILTERS) for i, x in enumerate(prefix)]
    return sum(d * factorial(len(FILTERS) - 1 - i) for i, d in enumerate(digits))


def intervals() -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank behind the last) of all orders in which documents of
    the mask go at the step: those whose first steps hold one letter of the mask, the last."""
    out = []
    for step in range(1, len(FILTERS) + 1):
        for prefix in map("".join, permutations(FILTERS, step)):
            low = rank(prefix)
            high = low + factorial(len(FILTERS) - step)
            for mask in range(1 << len(FILTERS)):
                if mask & bit(prefix[-1]) and not any(mask & bit(x) for x in prefix[:-1]):
                    out.append((mask, step, low, high))
    return out


def failed_rules(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest of the text and mask of filters A to D of every document."""
    text = F.coalesce("text", F.lit(""))
    fails = lambda letter, test: F.when(test, bit(letter)).otherwise(0)
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    by_words = let(word_array(text), lambda w: fails("A", F.size(w) < MIN_WORDS) + fails("B", 100 * F.size(F.array_distinct(w)) < DISTINCT_PERCENT * F.size(w)))
    mask = by_words + fails("C", 100 * capitals > CAPITAL_PERCENT * F.length(text)) + fails("D", text.rlike(SYMBOLS))
    return docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), mask.alias("mask"))


def masked_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by the filters they fail, and how many of them
    are labelled good and toxic.

    Equal texts have equal masks but for E, which spares the rows of their smallest doc_id.
    So rows are counted by digest, part and labels, each count with its smallest doc_id and
    the rows that have it, and only these few counts of a text meet."""
    rows = failed_rules(docs).groupBy("digest", "part", "mask", "doc_id").agg(F.count("*").alias("n"))
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("is_good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("is_toxic"))
    named = rows.where("doc_id is not null").join(marks, "doc_id", "left")
    unnamed = rows.where("doc_id is null").withColumns({"is_good": F.lit(None).cast("boolean"), "is_toxic": F.lit(None).cast("boolean")})
    kinds = ["digest", "part", "mask", "is_good", "is_toxic"]
    marked = named.unionByName(unnamed).withColumns({c: F.coalesce(c, F.lit(False)) for c in ("is_good", "is_toxic")})
    known = F.col("doc_id").isNotNull()
    first = F.min(F.when(known, F.struct("doc_id", "n")))
    # rows of one doc_id and text in one part and kind are one row by now, so n is all of it
    groups = marked.groupBy(*kinds).agg(F.sum("n").alias("n"), first.alias("first"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("spared"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    spared = F.col("spared") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = groups.withColumn("least", least).withColumn("spared", spared)
    sides = F.explode(F.array(F.struct(F.col("spared").alias("n"), F.col("mask")), F.struct((F.col("n") - F.col("spared")).alias("n"), (F.col("mask") + bit("E")).alias("mask"))))
    apart = split.select("part", "is_good", "is_toxic", sides.alias("x")).where("x.n > 0")
    only = lambda flag: F.coalesce(F.sum(F.when(F.col(flag), F.col("x.n"))), F.lit(0))
    return apart.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), only("is_good").alias("good"), only("is_toxic").alias("toxic"))


def audit(counts: DataFrame) -> DataFrame:
    """The report over the counts of `masked_counts`: part, filter_order, step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark = counts.sparkSession
    measures = ["n", "good", "toxic"]
    spans = spark.createDataFrame(intervals(), "mask int, step int, low int, high int")
    orders = spark.createDataFrame([(r, "".join(p), k + 1, x, bit(x)) for r, p in enumerate(permutations(FILTERS)) for k, x in enumerate(p)], "rank int, filter_order string, step int, letter string, letter_bit int")
    signed = lambda rank, sign: F.struct(F.col(rank).alias("rank"), *[(sign * F.col(m)).alias(m) for m in measures])
    ends = counts.join(spans, "mask").select("part", "step", F.explode(F.array(signed("low", 1), signed("high", -1))).alias("x"))
    steps = ends.groupBy("part", "step", "x.rank").agg(*[F.sum(f"x.{m}").alias(m) for m in measures])
    fails = lambda letter: F.sum(F.when(F.col("mask").bitwiseAND(bit(letter)) > 0, F.col("n")).otherwise(0))
    alone = lambda letter: F.sum(F.when(F.col("mask") == bit(letter), F.col("n")).otherwise(0))
    totals = counts.groupBy("part").agg(F.sum("n").alias("total"), *[f(x).alias(f"{name}_{x}") for x in FILTERS for name, f in (("fails", fails), ("alone", alone))])
    pick = lambda name: F.coalesce(*[F.when(F.col("letter") == x, F.col(f"{name}_{x}")) for x in FILTERS])
    spine = totals.withColumn("o", F.explode(F.array(*[F.lit(r) for r in range(factorial(len(FILTERS)))]))).withColumnRenamed("o", "rank").join(orders, "rank")
    dense = spine.join(steps, ["part", "step", "rank"], "left")
    up_to = lambda *keys: Window.partitionBy("part", *keys).rowsBetween(Window.unboundedPreceding, 0)
    summed = dense.withColumns({f"{m}_here": F.coalesce(F.sum(m).over(up_to("step").orderBy("rank")), F.lit(0)) for m in measures})
    out = summed.withColumns({
        "kept": F.col("total") - F.sum("n_here").over(up_to("rank").orderBy("step")),
        "shapley": F.sum("n_here").over(Window.partitionBy("part", "letter")),
    })
    return out.select(
        "part", "filter_order", "step", "kept", F.col("n_here").alias("removed"), (pick("fails") - F.col("n_here")).alias("redundant"),
        pick("alone").alias("unique_fails"), F.col("good_here").alias("good_lost"), F.col("toxic_here").alias("toxic_lost"), "shapley",
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The five filters over whole texts, for each part (lang; null: empty) and each of the
    120 orders: `audit` describes the columns.

    Null text counts as empty. A null doc_id is smaller and larger than no other: such rows
    never fail E and never make others fail it. Rows repeated with one doc_id and text count
    each and spare each other. Labels of one doc_id count as good or toxic if any of them
    says so. An empty table has no parts and gives no rows. Texts of any length are read
    whole; other columns are ignored."""
    return audit(write_through(masked_counts(docs.select("doc_id", "lang", "text"), labels.select("doc_id", "quality", "toxic")), "filter-masks"))
