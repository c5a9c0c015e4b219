"""Benchmark questions inside documents, re-parameterised ones too.

Texts become templates: numbers, names and units turn into typed placeholders, other words
into lower case without punctuation. Windows of template words are joined by hash. Along
each alignment of a document with an item the placeholders must map consistently: equal
values of the item to equal values of the document and the other way round."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_through
from .base import BYTE, arrow_map, bit_filter, mix64, passes, span_hashes, text_bytes, window_hashes, word_spans

#: template words of a window, and how many of them must be plain words
WIDTH, PLAIN = 8, 4
#: share of an item's windows that an alignment must match
COVER = 0.5
#: shifts of one alignment differ by so many words, and one more for each so many windows
DRIFT, DRIFT_EACH = 4, 16
#: how many placeholders may contradict, as a share of those aligned
SLIPS = 0.1

#: units, as fixed values
UNITS = "mm cm m km in ft yd mi mg g kg lb oz ml l s min h hr hrs kb mb gb tb hz khz mhz w kw kwh v a mph kmh km/h cents usd eur gbp percent meters metres kilometers kilometres miles feet inches grams kilograms pounds ounces litres liters seconds minutes hours days weeks months years dollars euros degrees".split()

#: spelt-out numbers, as fixed values; words that are articles too are left out
ONES = "one two three four five six seven eight nine".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
EINER = "ein zwei drei vier fünf sechs sieben acht neun".split()
ZEHNER = "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig".split()
NUMBERS = [
    *ONES, *TENS, *EINER[1:], *ZEHNER,
    *"zero ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen hundred thousand million billion dozen".split(),
    *"null eins zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn hundert tausend dutzend".split(),
    *"cero dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil docena".split(),
    *"zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille douzaine".split(),
]

_KEEP = np.zeros(256, bool)
_KEEP[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 58, 63]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_BYTE = BYTE[_LOWER]
NUMBER, NAME, UNIT = (mix64(np.array([k], np.uint64))[0] for k in (101, 102, 103))


def _listed(words: list[str]) -> np.ndarray:
    array = np.frombuffer(" ".join(words).encode(), np.uint8)
    starts, ends, _ = word_spans(array, np.array([0, len(array)]))
    return np.unique(span_hashes(array, starts, ends, _LOWER_BYTE))


_UNITS = _listed([re.sub("[^a-z]", "", u) for u in UNITS])
_NUMBERS = _listed([*NUMBERS, *(t + o for t in TENS for o in ONES), *(o + "und" + t for o in EINER for t in ZEHNER)])


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int32), np.cumsum(flags, dtype=np.int32)])


def _split_units(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with those that are a number and a listed unit, such as 5km, cut in two."""
    digits = _sums(_DIGIT[data])
    spots = np.flatnonzero(_DIGIT[data])
    mixed = np.flatnonzero((digits[ends] > digits[starts]) & (_KEEP & ~_DIGIT)[data[ends - 1]])
    cut = spots[digits[ends[mixed]] - 1] + 1
    kept = np.flatnonzero(_KEEP[data])
    before = np.searchsorted(kept, cut)
    leads = _DIGIT[data[kept[np.searchsorted(kept, starts[mixed])]]]
    tails = span_hashes(data[kept], before, np.searchsorted(kept, ends[mixed]), _LOWER_BYTE) if len(mixed) else np.zeros(0, np.uint64)
    cut = cut[leads & np.isin(tails, _UNITS)]
    return np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))


def _join_runs(first, template, plain, value, kept, low, high, near):
    """Runs of placeholders of one kind with nothing but space between them as one
    placeholder each. Its value is that of all letters and digits; where a later part is
    not a group of three digits, its place counts as well."""
    join = np.zeros(len(template), bool)
    join[1:] = ~plain[1:] & ~plain[:-1] & (template[1:] == template[:-1]) & near[1:]
    join[first[:-1][first[:-1] < len(template)]] = False
    if not join.any():
        return first, template, plain, value
    heads = np.flatnonzero(~join)
    lasts = np.append(heads[1:], len(join)) - 1
    value_of = value[heads].copy()
    many = np.flatnonzero(lasts > heads)
    whole = span_hashes(kept, low[heads[many]], high[lasts[many]], _LOWER_BYTE)
    owner = np.cumsum(~join) - 1
    digits = _sums(_DIGIT[kept])
    apart = np.flatnonzero(join & ~((template == NUMBER) & (high - low == 3) & (digits[high] - digits[low] == 3)))
    places = np.zeros(len(heads), np.uint64)
    np.add.at(places, owner[apart], mix64((low[apart] - low[heads[owner[apart]]]).astype(np.uint64)))
    value_of[many] = whole + places[many]
    return np.searchsorted(heads, first), template[heads], plain[heads], value_of


def templates(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, template, plain, value) of a batch: for each text its first template word,
    and for each word the hash of its placeholder or of itself, whether it is plain, and
    the hash of its letters and digits.

    A word with a digit or a listed one is a number, and a unit written onto a number a
    word of its own. A unit is a listed word after a number. A name begins with a capital,
    goes on in lower case and stands after a word that does not end a sentence and has
    small letters itself; in the second reading it may stand anywhere.
    Placeholders of one kind side by side are one. Letters beyond ASCII are lowered as far
    as the two-byte ones of western Europe go. Words without letters and digits are left
    out."""
    return readings(column)[TEMPLATE]


#: readings of a text: by its template, by that with all capitalised words as names, and
#: by its words as they stand
TEMPLATE, CAPITALS, VERBATIM = range(3)


def readings(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, words, plain, value) of a batch, for each reading."""
    data, offsets = text_bytes(column)
    data = data.copy()
    two = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97))
    capital_two = np.zeros(len(data) + 1, bool)
    capital_two[two] = True
    data[two + 1] += 0x20
    starts, ends, _ = word_spans(data, offsets)
    if not len(starts):
        return [(np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.uint64))] * 3
    letters = _sums(_KEEP[data])
    solid = letters[ends] > letters[starts]
    starts, ends = _split_units(data, starts[solid], ends[solid])
    kept = letters[ends] - letters[starts]
    first = np.searchsorted(starts, offsets)
    digit, small = _sums(_DIGIT[data]), _sums((data >= 97) & (data <= 122))
    spots = np.flatnonzero(_KEEP[data])
    low = letters[starts].astype(np.int64)
    value = span_hashes(data[spots], low, low + kept, _LOWER_BYTE)
    begin = spots[low]
    number = (digit[ends] - digit[starts] > 0) | np.isin(value, _NUMBERS)
    lower = small[ends] - small[starts]
    capital = ((data[begin] >= 65) & (data[begin] <= 90)) | capital_two[begin]
    after = np.zeros(len(starts), bool)
    after[1:] = ~_STOP[data[ends[:-1] - 1]] & (lower[:-1] > 0)
    after[first[:-1][first[:-1] < len(starts)]] = False
    broken = _sums(data == 10)
    after[1:] &= broken[starts[1:]] == broken[ends[:-1]]
    cased = ~number & capital & (kept > 1) & (lower >= kept // 2)
    unit = np.zeros(len(starts), bool)
    unit[1:] = number[:-1] & ~number[1:] & np.isin(value[1:], _UNITS)
    unit[first[:-1][first[:-1] < len(starts)]] = False
    near = np.zeros(len(starts), bool)
    near[1:] = _KEEP[data[ends[:-1] - 1]] & _KEEP[data[starts[1:]]]
    out = []
    for name in (cased & after, cased):
        template = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, value)))
        out.append(_join_runs(first, template, ~(number | unit | name), value, data[spots], low, low + kept, near))
    return [*out, (first, value, ~(number | unit | cased), value)]


def windows(kind: int, width: int, reading: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash): windows of so many words of one reading that lie in one text.
    Those of templates have PLAIN plain words; verbatim ones may have any. Hashes of
    different readings and widths differ."""
    first, words, plain, _ = reading
    hashes = window_hashes(words, width)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(text[: len(hashes)] == text[len(text) - len(hashes) :]) if len(hashes) else np.zeros(0, np.int64)
    if kind != VERBATIM:
        sums = np.concatenate([[0], np.cumsum(plain)])
        at = at[sums[at + width] - sums[at] >= PLAIN]
    salt = mix64(np.array([kind * 16 + width + 1], np.uint64))[0]
    return text[at], at - first[text[at]], mix64(hashes[at] ^ salt)


def benchmark_windows(items: DataFrame) -> DataFrame:
    """item_id, item_place, hash, item_slots, item_values, kind, width, item_index,
    n_windows: the windows of each reading of each item, numbered from 0, of WIDTH words,
    or one of all words of a shorter item."""

    def run(batch: pa.RecordBatch):
        for kind, reading in enumerate(readings(batch.column(1))):
            n = np.diff(reading[0])
            for width in range(1, WIDTH + 1):
                text, place, hashes = windows(kind, width, reading)
                mine = (n[text] == width) | ((width == WIDTH) & (n[text] > width))
                text, place, hashes = text[mine], place[mine], hashes[mine]
                count = np.bincount(text, minlength=batch.num_rows)
                found = _records(batch.column(0), text, place, hashes, width, reading, ["item_id", "item_place", "hash", "item_slots", "item_values"])
                index = np.arange(len(text)) - np.searchsorted(text, text)
                more = [("kind", np.full(len(text), kind)), ("width", np.full(len(text), width)), ("item_index", index), ("n_windows", count[text])]
                yield pa.RecordBatch.from_arrays([*found.columns, *[pa.array(c.astype(np.int32)) for _, c in more]], [*found.schema.names, *[k for k, _ in more]])

    return arrow_map(items.select("item_id", "text"), run, "item_id bigint, item_place int, hash bigint, item_slots array<int>, item_values array<bigint>, kind int, width int, item_index int, n_windows int")


def _records(ids, text, place, hashes, width, reading, names):
    """A row for each window with the places in the text and the values of its placeholders."""
    first, _, plain, value = reading
    slots, values = [], []
    for t, p in zip(text, place, strict=True):
        begin = first[t] + p
        held = np.flatnonzero(~plain[begin : begin + width])
        slots.append((held + p).astype(np.int32))
        values.append(value[begin : begin + width][held].view(np.int64))
    columns = [ids.take(pa.array(text)), pa.array(place.astype(np.int32)), pa.array(hashes.view(np.int64)), pa.array(slots, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names)


def document_windows(rows: DataFrame, bits: np.ndarray, widths: list[tuple[int, int]]) -> DataFrame:
    """row, doc_place, hash, doc_slots, doc_values: the windows that pass the filter, of
    those readings and widths (kind, width) that items have."""
    held = rows.sparkSession.sparkContext.broadcast(bits)

    def run(batch: pa.RecordBatch):
        read = readings(batch.column(1))
        for kind, width in widths:
            text, place, hashes = windows(kind, width, read[kind])
            hit = passes(held.value, hashes)
            if hit.any():
                yield _records(batch.column(0), text[hit], place[hit], hashes[hit], width, read[kind], ["row", "doc_place", "hash", "doc_slots", "doc_values"])

    return arrow_map(rows.select("row", "text"), run, "row bigint, doc_place int, hash bigint, doc_slots array<int>, doc_values array<bigint>")


def covered(found: DataFrame, support: DataFrame, key: list[str]) -> DataFrame:
    """key, matched, n_windows: how many of the item's windows each alignment covers. Those
    between two that match are covered too if the shift changes there and, in the item, no
    more words lie between the two than the change leaves out."""
    same = [F.col(f"f.{k}").eqNullSafe(F.col(f"p.{k}")) for k in key] + [F.col("f.shift") == F.col("p.shift")]
    places = found.alias("f").join(support.alias("p"), reduce(and_, same)).select("f.*", "p.support")
    best = F.max_by(F.struct("shift", "item_index", "width", "n_windows"), F.struct("support", -F.col("shift"))).alias("x")
    places = places.groupBy(*key, "item_place").agg(best).select(*key, "item_place", "x.*")
    ahead = Window.partitionBy(*key).orderBy("item_place")
    last = {c: F.lag(c).over(ahead).alias(f"last_{c}") for c in ("item_place", "shift", "item_index")}
    places = places.select("*", *last.values())
    step, left_out = F.col("item_place") - F.col("last_item_place"), F.col("last_shift") - F.col("shift")
    bridge = (left_out != 0) & (step > left_out) & (step - F.col("width") <= F.greatest(left_out, F.lit(0)))
    between = F.when(bridge, F.col("item_index") - F.col("last_item_index") - 1).otherwise(0)
    return places.groupBy(*key).agg((F.count("*") + F.sum(between)).cast("long").alias("matched"), F.max("n_windows").alias("n_windows"))


def matches(rows: DataFrame, items: DataFrame) -> DataFrame:
    """row, item_id, kind, band, shift, matched, n_windows, slots, changed, slips: each
    alignment of a reading of a text (row, text) with that of an item (item_id, text), the
    item's windows it matches, and of the placeholders in them how many there are, how many
    hold another value than the item and how many contradict the most frequent mapping.
    Where a window matches verbatim, they hold the item's values.

    Words put in or left out shift what follows them, so an alignment is a band of shifts.
    Bands overlap by half: shifts that differ by the drift an item allows share one. The
    shift given is the one with most windows; a window or placeholder that several shifts
    reach counts for the one with most."""
    item_windows = write_through(benchmark_windows(items), "benchmark-windows")
    widths = sorted((r["kind"], r["width"]) for r in item_windows.select("kind", "width").distinct().collect())
    found = document_windows(rows, bit_filter(item_windows, "hash"), widths).join(item_windows, "hash")
    found = found.withColumns({"shift": F.col("doc_place") - F.col("item_place"), "doc_values": F.when(F.col("kind") == VERBATIM, F.col("item_values")).otherwise(F.col("doc_values"))})
    drift = F.lit(DRIFT + 1) + F.floor(F.col("n_windows") / DRIFT_EACH)
    half = F.floor(F.col("shift") / drift)
    found = found.withColumn("band", F.explode(F.array(half, half - 1)))
    key = ["row", "item_id", "kind", "band"]
    found = write_through(found.select(*key, "shift", "item_place", "item_index", "width", "n_windows", "item_slots", "item_values", "doc_values"), "benchmark-hits")
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in key]
    support = found.groupBy(*key, "shift").agg(F.count_distinct("item_place").alias("support"))
    most = support.groupBy(*key).agg(F.max(F.struct("support", (-F.col("shift")).alias("place"))).alias("m")).select(*key, (-F.col("m.place")).alias("shift"))
    cover = covered(found, support, key)
    slots = found.select(*key, "shift", F.explode(F.arrays_zip("item_slots", "item_values", "doc_values")).alias("s")).select(*key, "shift", "s.*").distinct()
    slots = slots.alias("s").join(support.alias("p"), reduce(and_, [*same("s", "p"), F.col("s.shift") == F.col("p.shift")]))
    slots = slots.select("s.*", F.struct("p.support", (-F.col("s.shift")).alias("place")).alias("by"))
    slots = slots.groupBy(*key, "item_slots").agg(F.max_by(F.struct("item_values", "doc_values"), "by").alias("v")).select(*key, "v.*")
    pairs = slots.groupBy(*key, "item_values", "doc_values").agg(F.count("*").alias("n"))
    by = lambda c: Window.partitionBy(*key, c).orderBy(F.desc("n"), F.desc("item_values"), F.desc("doc_values"))
    ranked = pairs.withColumns({"a": F.row_number().over(by("item_values")), "b": F.row_number().over(by("doc_values"))})
    slips = ranked.groupBy(*key).agg(
        F.sum("n").alias("slots"), F.sum(F.when(F.col("item_values") != F.col("doc_values"), F.col("n")).otherwise(0)).alias("changed"),
        F.sum(F.when((F.col("a") > 1) | (F.col("b") > 1), F.col("n")).otherwise(0)).alias("slips"),
    )
    zero = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("slots", "changed", "slips")}
    out = cover.alias("c").join(most.alias("m"), reduce(and_, same("c", "m"))).join(slips.alias("x"), reduce(and_, same("c", "x")), "left")
    return out.select(*[f"c.{k}" for k in key], "m.shift", "c.matched", "c.n_windows", *zero.values())


def leaks(found: DataFrame) -> DataFrame:
    """The best alignment of each text with each item that covers enough of the item and is
    consistent: most windows, then fewest contradictions, then fewest changes, then the
    first reading and place."""
    good = found.where((F.col("matched") >= COVER * F.col("n_windows")) & (F.col("slips") <= SLIPS * F.col("slots")))
    order = ["matched", (-F.col("slips")).alias("order"), (-F.col("changed")).alias("same"), (-F.col("kind")).alias("reading"), (-F.col("shift")).alias("place")]
    best = F.max(F.struct(*order, "n_windows", "slots", "changed", "slips", "shift")).alias("x")
    return good.groupBy("row", "item_id").agg(best).select("row", "item_id", "x.shift", "x.matched", "x.n_windows", "x.slots", "x.changed", "x.slips")


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, shift, matched, n_windows, slots, changed, slips, exact: a row for
    each document and item of which the document holds COVER of the windows or more, with
    consistent placeholders; exact if no placeholder differs.

    Null texts hold nothing. Rows are known by doc_id and text, so different texts with one
    doc_id, or without one, are aligned apart, and the best alignment of an id is given;
    repeated rows count once. Texts of any length are read whole. Items with too few plain
    words for a window of their template are found where their words stand as they are,
    however few they are. Empty tables give no rows; other columns are ignored."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    found = write_through(leaks(matches(rows.select("row", "text"), items)), "leaks")
    named = found.join(rows.select("row", "doc_id").distinct(), "row")
    order = F.struct("matched", (-F.col("slips")).alias("order"), (-F.col("changed")).alias("same"), (-F.col("shift")).alias("place"))
    best = F.max_by(F.struct("shift", "matched", "n_windows", "slots", "changed", "slips"), order).alias("x")
    return named.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.*").withColumn("exact", F.col("changed") == 0)


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns. Rows are known by doc_id
    and text, so repeated rows go or stay together."""
    key = F.xxhash64("doc_id", "text")
    found = leaks(matches(docs.select(key.alias("row"), "text"), items))
    bad = write_through(found.select(F.col("row").alias("__leaking")).distinct(), "leaking-documents")
    return docs.join(bad, key == bad["__leaking"], "left_anti")
