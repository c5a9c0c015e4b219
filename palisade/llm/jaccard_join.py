"""Documents that share most of their word n-grams, found exactly.

Each document is the set of its distinct shingles. Sets that reach the similarity share a
shingle among the first few of each in any common order, so only sets with such a shingle
in common meet; frequent shingles come last in that order. What meets is compared in tiles
of near sizes by bitmap signatures, whose bit counts bound the overlap from above, and what
remains by intersecting sorted arrays."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_through
from .base import BYTE, arrow_map, bit_filter, free_name, mix64, passes, release, settle, span_hashes, text_bytes, window_hashes, word_spans
from .components import components

WIDTH = 5
#: the similarity as a fraction of whole numbers
PART, WHOLE = 4, 5
#: a shingle that more than so many texts hold comes last in the order
FREQUENT = 64
#: shingles are counted in so many parts, by their first bits, and told apart by the next 32
PARTS = 1 << 12
#: rounds in which each tile compares its sets with one of them, before all that is left
ROUNDS = 2
#: bitmaps have as many bits as the next power of two above the size, within these
LEAST_BITS, MOST_BITS = 1 << 6, 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_BYTE = BYTE[_LOWER]


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text with fewer words is one
    shingle, one without words has none."""
    data, offsets = text_bytes(column)
    starts, ends, first = word_spans(data, offsets)
    words = span_hashes(data, starts, ends, _LOWER_BYTE)
    hashes = window_hashes(words, WIDTH).view(np.int64)
    out = []
    for low, high in zip(first[:-1], first[1:], strict=True):
        n = int(high - low)
        if n >= WIDTH:
            out.append(np.unique(hashes[low : high - WIDTH + 1]))
        elif n:
            out.append(mix64(window_hashes(words[low:high], n) + np.uint64(n)).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def set_key(tokens: np.ndarray) -> int:
    """One number for a set; equal sets have equal numbers."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def prefix_length(n: int) -> int:
    """So many first shingles hold one in common with every set similar enough."""
    return n - -(-n * PART // WHOLE) + 1 if n else 0


def prefix(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, int]:
    """The first shingles, frequent ones last, and how many in a thousand of all shingles
    are not frequent."""
    late = passes(frequent, tokens)
    ordered = np.concatenate([tokens[~late], tokens[late]])[: prefix_length(len(tokens))]
    return ordered, 1000 * int((~late).sum()) // max(1, len(tokens))


def bitmap(tokens: np.ndarray) -> bytes:
    bits = min(max(LEAST_BITS, 1 << max(0, len(tokens) - 1).bit_length()), MOST_BITS)
    flags = np.zeros(bits, bool)
    flags[tokens & (bits - 1)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        bits = bits[: len(bits) // 2] | bits[len(bits) // 2 :]
    return bits


def may_link(n: int, m: int, x: bytes, y: bytes) -> bool:
    """False if sizes or bit counts rule the similarity out: every bit in which the bitmaps
    differ stands for a shingle that one set lacks."""
    if min(n, m) * WHOLE < max(n, m) * PART:
        return False
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(a), len(b))
    differ = int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())
    overlap = (n + m - differ) // 2
    return overlap * WHOLE >= (n + m - overlap) * PART


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """The exact test on sorted arrays without repeats."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    overlap = int((both[1:] == both[:-1]).sum())
    return overlap * WHOLE >= (len(x) + len(y) - overlap) * PART


def dealt_shingles(docs: DataFrame) -> DataFrame:
    """part, tokens: the shingles of a batch of texts by their first bits, four bytes each.
    One that more than FREQUENT texts of the batch hold is there FREQUENT + 1 times, others
    as often as texts hold them."""
    bits = PARTS.bit_length() - 1

    def run(batch: pa.RecordBatch):
        tokens, n = np.unique(np.concatenate(shingle_sets(batch.column(0))).view(np.uint64), return_counts=True)
        tokens = np.repeat(tokens, np.minimum(n, FREQUENT + 1))
        if len(tokens):
            parts, starts = np.unique((tokens >> np.uint64(64 - bits)).astype(np.int32), return_index=True)
            rest = (tokens >> np.uint64(32 - bits)).astype(np.uint32)
            offsets = np.append(starts, len(tokens)).astype(np.int32) * 4
            packed = pa.Array.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(offsets), pa.py_buffer(rest)])
            yield pa.RecordBatch.from_arrays([pa.array(parts), packed], ["part", "tokens"])

    return arrow_map(docs.select("text"), run, "part int, tokens binary")


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """A filter of the shingles that more than FREQUENT texts have. It only sets the order
    of shingles, in which any other that passes may come late as well. Passages that many
    texts share are late then, unless a text holds little else, and do not bring these
    texts together. All shingles of all texts are counted; they travel packed, a row for a
    batch and part, and not in a row each."""
    bits = PARTS.bit_length() - 1

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        rest, n = np.unique(np.frombuffer(b"".join(rows["tokens"].to_pylist()), np.uint32), return_counts=True)
        first = np.uint64(key[0].as_py()) << np.uint64(64 - bits)
        tokens = first | (rest[n > FREQUENT].astype(np.uint64) << np.uint64(32 - bits))
        return pa.table({"token": pa.array(tokens.view(np.int64))})

    return bit_filter(dealt_shingles(docs).groupBy("part").applyInArrow(count, "token bigint"), "token")


def first_shingles(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """set, n, lone, bits, tokens, place: each set's size, rare shingles in a thousand,
    bitmap and first shingles. Of documents with equal sets the smallest place stands for
    all."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batch: pa.RecordBatch):
        sets = shingle_sets(batch.column(0))
        some = [i for i, s in enumerate(sets) if len(s)]
        firsts = [prefix(sets[i], held.value) for i in some]
        columns = [pa.array([set_key(sets[i]) for i in some], pa.int64()), pa.array([len(sets[i]) for i in some], pa.int64()), pa.array([lone for _, lone in firsts], pa.int32()), pa.array([bitmap(sets[i]) for i in some], pa.binary()), pa.array([t for t, _ in firsts], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*columns, batch.column(1).take(pa.array(some, pa.int64()))], ["set", "n", "lone", "bits", "tokens", "place"])

    rows = arrow_map(docs.select("text", "place"), run, "set bigint, n bigint, lone int, bits binary, tokens array<bigint>, place bigint")
    return rows.groupBy("set").agg(*[F.first(c).alias(c) for c in ("n", "lone", "bits", "tokens")], F.min("place").alias("place"))


def meetings(sets: DataFrame) -> DataFrame:
    """token, rank, set, n, lone: first shingles that two sets or more have in
    common, and how many of the set's come before in the order. Only shingles are counted
    across all sets; a filter of fixed size keeps most rows of others out of the join."""
    counts = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("times"))
    shared = settle(counts.where("times > 1").select("token"), "shared-shingles")
    held = sets.sparkSession.sparkContext.broadcast(bit_filter(shared, "token"))

    def run(batch: pa.RecordBatch):
        lists = batch.column(0)
        tokens, offsets = lists.flatten().to_numpy(), np.asarray(lists.offsets)
        row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        rank = np.arange(len(tokens)) - (offsets[:-1] - offsets[0])[row]
        hit = passes(held.value, tokens)
        others = [c.take(pa.array(row[hit])) for c in batch.columns[1:]]
        yield pa.RecordBatch.from_arrays([pa.array(tokens[hit]), pa.array(rank[hit], pa.int64()), *others], ["token", "rank", "set", "n", "lone"])

    rows = arrow_map(sets.select("tokens", "set", "n", "lone"), run, "token bigint, rank bigint, set bigint, n bigint, lone int")
    return rows.join(shared, "token", "left_semi")


def describe(docs: DataFrame) -> DataFrame:
    """docs without text, and n_shingles and set of each document."""
    others = [c for c in docs.columns if c != "text"]
    kinds = dict(docs.dtypes)

    def run(batch: pa.RecordBatch):
        sets = shingle_sets(batch.column(len(others)))
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.int64())], [*others, "n_shingles", "set"])

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in others], "n_shingles bigint", "set bigint"])
    return arrow_map(docs.select(*others, "text"), run, schema)


def set_table(texts: DataFrame, wanted: np.ndarray) -> DataFrame:
    """set, tokens of the texts (place, text) whose place passes the filter: sorted
    shingles. Only rows that repeat can give a set twice."""
    held = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batch: pa.RecordBatch):
        hit = batch.filter(pa.array(passes(held.value, batch.column(0).to_numpy())))
        if hit.num_rows:
            sets = [s for s in shingle_sets(hit.column(1)) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["set", "tokens"])

    return arrow_map(texts.select("place", "text"), run, "set bigint, tokens array<bigint>")


def verify(pairs: DataFrame, texts: DataFrame, signs: DataFrame) -> DataFrame:
    """a, b: the pairs of sets that are similar. First sizes and bitmaps, a few bytes a
    set, rule out most of the others. The sets of the pairs left, far fewer than those that
    meet, are made from their texts again and written; then each pair's shingles are joined
    and intersected. A set in many pairs is a skewed
    join key, which Spark splits."""
    side = lambda name: signs.select(F.col("set").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("n", "bits", "place")])
    tiles = pairs.join(side("a"), "a").join(side("b"), "b")
    near = F.least("a_n", "b_n") * WHOLE >= F.greatest("a_n", "b_n") * PART

    def by_bits(batch: pa.RecordBatch):
        n, x, m, y = batch.select([4, 5, 6, 7]).to_pydict().values()
        keep = [may_link(*p) for p in zip(n, m, x, y, strict=True)]
        yield batch.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))

    columns = ["a", "b", "a_place", "b_place"]
    close = settle(arrow_map(tiles.where(near).select(*columns, "a_n", "a_bits", "b_n", "b_bits"), by_bits, ", ".join(f"{c} bigint" for c in columns)), "close-sets")
    places = close.select(F.explode(F.array("a_place", "b_place")).alias("place"))
    sets = settle(set_table(texts, bit_filter(places, "place")), "sets")

    def by_shingles(batch: pa.RecordBatch):
        x, y = batch.column(2), batch.column(3)
        keep = [linked(x[i].values.to_numpy(), y[i].values.to_numpy()) for i in range(batch.num_rows)]
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    whole = lambda name: sets.select(F.col("set").alias(name), F.col("tokens").alias(f"{name}_tokens")).dropDuplicates([name])
    joined = close.select("a", "b").join(whole("b"), "b").join(whole("a"), "a")
    return settle(arrow_map(joined.select("a", "b", "a_tokens", "b_tokens"), by_shingles, "a bigint, b bigint"), "similar-sets")


def may_reach(n: Column, rank: Column, m: Column, other: Column) -> Column:
    """False if sets of n and m shingles cannot be similar although they have the one with
    these ranks in common: when it is their first, each must still hold the whole overlap."""
    left = F.least(n - rank, m - other)
    return (left * (WHOLE + PART) >= (n + m) * PART) & (F.least(n, m) * WHOLE >= F.greatest(n, m) * PART)


def set_components(met: DataFrame, texts: DataFrame, signs: DataFrame) -> DataFrame:
    """node, component over sets. A pair that is already connected need not be compared.
    So each round takes one set of every token's meeting and compares with it all that are
    not connected to it yet. The first round takes the set with the smallest share of rare
    shingles, which is the middle of a group of near copies; the next takes any. The sets
    left unconnected in a meeting are then compared pair by pair, split into bands of near
    sizes, as far as their ranks let them reach the similarity."""
    links = met.sparkSession.createDataFrame([], "a bigint, b bigint")
    labelled = met.withColumn("component", F.col("set"))
    for turn in range(ROUNDS):
        order = F.col("lone") if turn == 0 else F.xxhash64("component", F.lit(turn))
        first = F.min(F.struct(order.alias("o"), F.col("set").alias("leader"), F.col("component").alias("led"), F.col("n").alias("m"), F.col("rank").alias("r"))).alias("x")
        leaders = labelled.groupBy("token").agg(first, F.min("component").alias("low"), F.max("component").alias("high"))
        open_ = leaders.where("low < high").select("token", "x.leader", "x.led", "x.m", "x.r")
        near = may_reach(F.col("n"), F.col("rank"), F.col("m"), F.col("r"))
        pairs = labelled.join(open_, "token").where((F.col("component") != F.col("led")) & near).select(F.col("set").alias("a"), F.col("leader").alias("b")).distinct()
        new = verify(pairs, texts, signs)
        if new.isEmpty():
            break
        links = write_through(links.union(new), "all-links")
        found = components(links).select(F.col("node").alias("set"), F.col("component").alias("c"))
        labelled = settle(met.join(found, "set", "left").select(*met.columns, F.coalesce("c", "set").alias("component")), "meetings")
    kinds = labelled.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token")
    band = F.floor(F.log(F.col("n")) / float(np.log(WHOLE / PART))).cast("int")
    rows = settle(labelled.join(kinds, "token", "left_semi").withColumn("band", band), "open-meetings")
    # of two sets, the overlap is at least 8/9 of the smaller one: where no more can be left of it, it meets no larger one
    small = rows.where((F.col("n") - F.col("rank")) * (WHOLE + PART) >= 2 * PART * F.col("n"))
    up = small.select("token", F.col("set").alias("s"), F.col("component").alias("c"), F.col("n").alias("m"), F.col("rank").alias("r"), F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    larger = (F.col("n") > F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("set") > F.col("s")))
    near = may_reach(F.col("n"), F.col("rank"), F.col("m"), F.col("r"))
    rest = rows.join(up, ["token", "band"]).where((F.col("component") != F.col("c")) & larger & near)
    pairs = rest.select(F.least("set", "s").alias("a"), F.greatest("set", "s").alias("b")).distinct()
    return components(links.union(verify(pairs, texts, signs)))


def similar_documents(docs: DataFrame) -> DataFrame:
    """docs without text, and n_shingles, set, component: documents with equal sets share a
    component, and so do those that links between similar sets connect. Documents without
    words have none (null)."""
    place = F.xxhash64(*[c for c in docs.columns if c != "text"], "text")
    texts = docs.select(place.alias("place"), "text")
    frequent = frequent_shingles(texts)
    release(docs.sparkSession)
    first = settle(first_shingles(texts, frequent), "first-shingles")
    met = settle(meetings(first), "meetings")
    signs = first.select("set", "n", "bits", "place")
    found = settle(set_components(met, texts, signs).select(F.col("node").alias("set"), "component"), "set-components")
    rows = describe(docs).join(found, "set", "left")
    return rows.withColumn("component", F.when(F.col("n_shingles") > 0, F.coalesce("component", "set")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, component_rows of every document.

    component_id is the smallest doc_id of the component. Null text and text without words
    have no shingles and stand alone. Repeated rows and rows with equal sets are in one
    component; a null doc_id is never the smallest, unless it is alone. An empty table
    gives no rows; other columns are ignored."""
    rows = write_through(similar_documents(docs.select("doc_id", "text")), "components")
    smallest = rows.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("rows"))
    out = rows.join(smallest, "component", "left")
    own = F.col("component").isNull()
    return out.select("doc_id", "n_shingles", F.when(own, F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"), F.coalesce("rows", F.lit(1)).alias("component_rows"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: that of the smallest doc_id, then
    of the smallest text hash; one of several equal rows. Rows without shingles all stay.
    A null doc_id comes last."""
    key = F.xxhash64("doc_id", "text")
    rows = write_through(similar_documents(docs.select("doc_id", key.alias("key"), "text")), "components")
    grouped = rows.where("component is not null")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key")
    best = grouped.groupBy("component").agg(F.min(order).alias("x")).select("x.key")
    repeated = grouped.groupBy("key").agg((F.count("*") > 1).alias("repeated"))
    alone = rows.where("component is null").select("key", F.lit(False).alias("repeated")).distinct()
    stay = write_through(best.join(repeated, "key").unionByName(alone).select(F.col("key").alias("__key"), F.col("repeated").alias("__repeated")), "kept-documents")
    k = free_name(docs, "__stay_")
    stay = stay.withColumnsRenamed({"__key": f"{k}key", "__repeated": f"{k}repeated"})
    kept = docs.join(stay, key == stay[f"{k}key"])
    once = kept.where(F.col(f"{k}repeated")).dropDuplicates([f"{k}key"])
    return kept.where(~F.col(f"{k}repeated")).union(once).drop(f"{k}key", f"{k}repeated")
