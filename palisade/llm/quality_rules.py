"""Quality rules with thresholds that follow the data.

Each document is measured with built-in functions. The measures of each language and
source go into quantile sketches: counts of logarithmic bins, which merge by addition and
do not depend on the order of rows. A document is rejected when a measure lies outside
the fence that its own group's sketch gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_through
from .base import free_name, let, word_array

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: bins keep the first so many bits of a value, so they are at most 1/128 wide
BITS = 8
#: a group needs so many documents for a sketch of its own
MIN_GROUP = 100
#: fences lie so many half-spreads away from the median: about eight standard deviations
REACH = 12
#: values so many times as large as those below stand apart
GAP = 20
#: what sets a measure's fence where half of all documents have one value: "both" asks a
#: wider group, "apart" looks for values that stand apart, "steps" takes the spread of the
#: documents that have any, as rates of lines and windows come in large steps
RULES = {"word_length": "both", "symbol_rate": "apart", "dup_line_rate": "steps", "repeat_rate": "steps"}
#: quantiles that are compared with each other to find values that stand apart, in a thousand
LADDER = [500, 750, 900, 950, 980, 990, 995, 999]
#: fence of a measure in which nothing stands out
NO_FENCE = 1 << 62
#: values measured for every document
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(words: Column, hashes: Column) -> Column:
    """Words inside windows that occur twice or more, the first time included. Windows are
    sorted by (hash, place); those with an equal neighbour repeat, and each covers the
    words up to the next one, WINDOW at most."""
    def equal(s: Column, i: Column, j: Column) -> Column:
        return s[i]["h"] == s[j]["h"]

    def places(s: Column) -> Column:
        n = F.size(s)
        marked = F.filter(s, lambda e, k: F.when(k > 0, equal(s, k, k - 1)).otherwise(False) | F.when(k + 1 < n, equal(s, k, k + 1)).otherwise(False))
        return F.array_sort(F.transform(marked, lambda e: e["p"]))

    ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    covered = let(let(ordered, places), lambda p: F.aggregate(
        F.transform(p, lambda x, k: F.when(k + 1 < F.size(p), F.least(F.lit(WINDOW), p[k + 1] - x)).otherwise(WINDOW)),
        F.lit(0).cast("long"), lambda a, x: a + x))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered)


def measure(docs: DataFrame, prefix: str = "") -> DataFrame:
    """docs with the base values, n_lines and the measures of RULES, named with the prefix.
    Rates are per thousand; word_length is in hundredths of a character."""
    q = lambda name: f"{prefix}{name}"
    text = F.coalesce(F.col("text"), F.lit(""))
    w, h, lines = q("words_array"), q("hash_array"), q("line_array")
    out = docs.withColumns({w: word_array(F.col("text")), lines: F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    starts = F.sequence(F.lit(1), F.size(w) - (WINDOW - 1))
    out = out.withColumn(h, F.when(F.size(w) > WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice(F.col(w), i, WINDOW)))).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumns({
        q("n_words"): F.size(w).cast("long"),
        q("word_chars"): F.length(F.array_join(w, "")).cast("long"),
        q("n_symbols"): F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        q("n_lines"): F.size(lines).cast("long"),
        q("n_dup_lines"): (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        q("n_repeat_words"): repeat_words(F.col(w), F.col(h)),
    }).drop(w, h, lines)
    share = lambda part, whole, unit: F.when(F.col(q(whole)) > 0, F.floor(F.col(q(part)) * unit / F.col(q(whole)))).otherwise(0).cast("long")
    return out.withColumns({
        q("word_length"): share("word_chars", "n_words", 100),
        q("symbol_rate"): share("n_symbols", "n_words", 1000),
        q("dup_line_rate"): share("n_dup_lines", "n_lines", 1000),
        q("repeat_rate"): share("n_repeat_words", "n_words", 1000),
        q("base_failed"): (F.col(q("n_words")) < MIN_WORDS) | (100 * F.col(q("n_repeat_words")) > MAX_REPEAT_PERCENT * F.col(q("n_words"))),
    })


def sketch(measured: DataFrame, prefix: str = "") -> DataFrame:
    """lang, source, measure, bin, n: the sketch of each group over the documents that pass
    the base rules. A bin is named by its smallest value. Sketches merge by adding n."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"{prefix}{m}").alias("v")) for m in RULES]))
    rows = measured.where(~F.col(f"{prefix}base_failed")).select("lang", "source", values.alias("x")).select("lang", "source", "x.measure", "x.v")
    cut = F.greatest(F.lit(0), F.length(F.bin("v")) - BITS)
    binned = rows.withColumn("cut", cut).withColumn("bin", F.expr("shiftleft(shiftright(v, cut), cut)"))
    return binned.groupBy("lang", "source", "measure", "bin").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    return sketches.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, total, q250 and those of LADDER: the smallest bin with that share of
    the count, in a thousand, at or below it. Bins of one group are few, whatever its size."""
    group = Window.partitionBy(*keys, "measure")
    ranked = sketches.withColumns({"total": F.sum("n").over(group), "below": F.sum("n").over(group.orderBy("bin"))})
    at = lambda share: F.min(F.when(1000 * F.col("below") >= share * F.col("total"), F.col("bin")))
    return ranked.groupBy(*keys, "measure", "total").agg(*[at(x).alias(f"q{x}") for x in (250, *LADDER)])


def levels(sketches: DataFrame, groups: DataFrame, two_sided: bool) -> DataFrame:
    """groups (lang, source, measure) with the quantiles of their own sketch, or of their
    language's merged sketch where they have fewer than MIN_GROUP documents, or else of all
    documents. With two_sided, a sketch of "both" that has no spread is passed over too, as
    in a source that is mostly copies of one text."""
    out = groups.alias("f")
    names = ["q250", *[f"q{x}" for x in LADDER]]
    for name, keys in {"g": ["lang", "source"], "l": ["lang"], "a": []}.items():
        on = F.col("f.measure") == F.col(f"{name}.measure")
        for k in keys:
            on = on & F.col(f"f.{k}").eqNullSafe(F.col(f"{name}.{k}"))
        out = out.join(quantiles(merge(sketches, keys), keys).alias(name), on, "left")

    def usable(name: str) -> Column:
        enough = F.col(f"{name}.total") >= MIN_GROUP
        flat = F.col("f.measure").isin([m for m, kind in RULES.items() if kind == "both"]) & (half_spread(f"{name}.", True) == 0)
        return enough & ~flat if two_sided else enough

    pick = lambda c: F.when(usable("g"), F.col(f"g.{c}")).when(usable("l"), F.col(f"l.{c}")).otherwise(F.col(f"a.{c}"))
    return out.select("f.lang", "f.source", "f.measure", *[pick(c).alias(c) for c in names])


def half_spread(prefix: str = "", either: bool = False) -> Column:
    """The smaller distance of a quartile from the median: a share of bad documents on one
    side of the median does not move it. With either, the larger one where that is 0, as
    copies of one text may fill a quarter."""
    q25, q50, q75 = (F.col(f"{prefix}{c}") for c in ("q250", "q500", "q750"))
    least = F.least(q50 - q25, q75 - q50)
    return F.when(least == 0, F.greatest(q50 - q25, q75 - q50)).otherwise(least) if either else least


def apart() -> Column:
    """The geometric middle of the widest step between neighbours of the LADDER, if that is
    at least GAP-fold; else no fence."""
    steps = []
    for low, high in zip(LADDER, LADDER[1:], strict=False):
        x, y = F.col(f"q{low}") + 1, F.col(f"q{high}") + 1
        steps.append(F.struct(F.floor(y / x).alias("ratio"), F.floor(F.sqrt(x * y)).alias("fence")))
    return let(F.array_max(F.array(*steps)), lambda s: F.when(s["ratio"] >= GAP, s["fence"]).otherwise(NO_FENCE))


def thresholds(sketches: DataFrame) -> DataFrame:
    """lang, source and for each measure lower and upper fence. Where the inner half of a
    distribution has a spread, fences lie REACH half-spreads from the median. Where it has
    none, the kind of the measure (RULES) says what sets the fence. The width of a bin is
    the least distance, as quantiles are known up to that."""
    groups = sketches.select("lang", "source", "measure").distinct()
    width = lambda c: F.shiftright(c, BITS - 1) + 1
    whole = levels(sketches, groups, True)
    some = levels(sketches.where("bin > 0"), groups, False)
    some = some.withColumn("some", F.col("q500") + F.greatest(REACH * half_spread(either=True), width("q500"))).select(F.col("lang").alias("some_lang"), F.col("source").alias("some_source"), F.col("measure").alias("some_measure"), "some")
    same = F.col("lang").eqNullSafe(F.col("some_lang")) & F.col("source").eqNullSafe(F.col("some_source")) & (F.col("measure") == F.col("some_measure"))
    wide, spread = REACH * half_spread(), half_spread() > 0
    distance = F.greatest(REACH * half_spread(either=True), width("q500"))
    fences = []
    for m, kind in RULES.items():
        mine = F.col("measure") == m
        upper = {"both": F.col("q500") + distance, "apart": F.when(spread, F.col("q500") + wide).otherwise(apart()), "steps": F.when(spread, F.col("q500") + wide).otherwise(F.coalesce("some", F.lit(NO_FENCE)))}[kind]
        lower = F.col("q500") - distance if kind == "both" else F.lit(-1)
        fences.append(F.max(F.when(mine, upper.cast("long"))).alias(f"{m}_upper"))
        fences.append(F.max(F.when(mine, lower.cast("long"))).alias(f"{m}_lower"))
    return whole.join(some, same, "left").groupBy("lang", "source").agg(*fences)


def judge(measured: DataFrame, fences: DataFrame, prefix: str = "", name: str = "kept") -> DataFrame:
    """measured with the verdict. Fences are joined by language and source, null matching
    null; a group without fences has no document that passed the base rules. Spark
    broadcasts the fences if their files are under its threshold and splits a hot source
    otherwise."""
    side_ = free_name(measured, "__fence_")
    side = fences.select(F.col("lang").alias(f"{side_}lang"), F.col("source").alias(f"{side_}source"), *[F.col(f"{m}_{e}").alias(f"{side_}{m}_{e}") for m in RULES for e in ("lower", "upper")])
    joined = measured.join(side, measured["lang"].eqNullSafe(side[f"{side_}lang"]) & measured["source"].eqNullSafe(side[f"{side_}source"]), "left")
    inside = ~F.col(f"{prefix}base_failed")
    for m in RULES:
        inside = inside & F.col(f"{prefix}{m}").between(F.col(f"{side_}{m}_lower"), F.col(f"{side_}{m}_upper"))
    return joined.withColumn(name, F.coalesce(inside, F.lit(False))).drop(*side.columns)


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base values, base_failed, kept and the measures of each document.

    Null text counts as empty and fails; null language or source is a group of its own.
    Repeated rows are judged each; an empty table gives no rows; other columns of docs are
    ignored. The measures, a few numbers a document, are written once and read
    twice; the sketches, whose bins do not grow with the documents, are written as well."""
    measured = write_through(measure(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality-measures")
    bins = write_through(sketch(measured), "quality-sketches")
    fences = write_through(thresholds(bins), "quality-fences")
    return judge(measured, fences).select("doc_id", *BASE, "base_failed", "kept", "n_lines", *RULES)


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that quality_rules keeps, with all their columns, whatever their
    names; null texts, repeated rows and empty tables as there. Rows are written with their
    measures: computed in the filter instead, each measure would be computed many times."""
    q = free_name(docs, "__q_")
    measured = write_through(measure(docs, q), "quality-documents")
    bins = write_through(sketch(measured, q), "quality-sketches")
    fences = write_through(thresholds(bins), "quality-fences")
    return judge(measured, fences, q, f"{q}kept").where(F.col(f"{q}kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
