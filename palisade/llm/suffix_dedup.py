"""Repeated passages of LENGTH bytes or more, removed where they come again.

Every string of LENGTH bytes has one anchor, the GRAM-byte substring of the smallest hash
in it, so equal strings have equal anchors at equal places. Anchors that occur once are
left behind. The strings around an anchor that occurs again are put into suffix order, in
which the nearest strings with smaller positions give the longest previous factor; where
that is LENGTH bytes, the string has started before."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_through
from .base import BYTE, arrow_map, bit_filter, bound_batches, mix64, passes, settle, text_bytes

LENGTH = 100
GRAM = 32
#: bytes of text that are hashed at once; with the position they fit into 24 bits
CHUNK = 1 << 20
#: bits of the filters: 8 MB
BITS = 26
#: an anchor with more different surroundings is compared string by string across tasks
CROWD = 4096


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position, by doubling."""
    h, width, k = BYTE[data], 1, 0
    while width < GRAM:
        h = h[:-width] * BYTE[k] + h[width:]
        h ^= h >> np.uint64(31)
        width, k = width * 2, k + 1
    return mix64(h)


def least_within(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` values."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, hash, low, high) for parts of a batch: the anchors of each text and the first
    and last start of the strings that have that anchor. Starts count from the text's
    beginning. A text longer than CHUNK is read in parts that overlap by LENGTH - 1."""
    jobs, group = [], []
    for i in range(len(offsets) - 1):
        low, high = int(offsets[i]), int(offsets[i + 1])
        if high - low < LENGTH:
            continue
        if high - low > CHUNK:
            jobs += [[(i, at, min(at + CHUNK + LENGTH - 1, high))] for at in range(low, high - LENGTH + 1, CHUNK)]
            continue
        if group and group[-1][2] - group[0][1] + high - low > CHUNK:
            jobs.append(group)
            group = []
        group.append((i, low, high))
    jobs += [group] if group else []
    for group in jobs:
        part = np.concatenate([data[a:b] for _, a, b in group])
        size = np.array([b - a for _, a, b in group])
        begin = np.cumsum(size) - size
        hashes = gram_hashes(part)
        keyed = (hashes & ~np.uint64(0xFFFFFF)) | np.arange(len(hashes), dtype=np.uint64)
        anchor = (least_within(keyed, LENGTH - GRAM + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        left = np.repeat(begin + size, size) - np.arange(len(part))
        start = np.flatnonzero(left >= LENGTH)
        at = anchor[start]
        new = np.ones(len(start), bool)
        new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        owner = np.searchsorted(begin, start[first], side="right") - 1
        shift = np.array([a - int(offsets[i]) for i, a, _ in group])[owner] - begin[owner]
        # an anchor's hash is the least of many; mixed again, its bits are even
        yield np.array([i for i, _, _ in group])[owner], mix64(hashes[at[first]] + BYTE[0]), start[first] + shift, start[last] + shift


def _digest(part: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little", signed=True)


def shared_anchors(docs: DataFrame, originals: np.ndarray) -> np.ndarray:
    """A filter of the anchors that occur twice or more."""
    held = docs.sparkSession.sparkContext.broadcast(originals)

    def run(batch: pa.RecordBatch):
        batch = batch.filter(pa.array(passes(held.value, batch.column(0).to_numpy())))
        for _, hashes, _, _ in anchors(*text_bytes(batch.column(1))):
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], ["hash"])

    counts = arrow_map(docs.select("place", "text"), run, "hash bigint").groupBy("hash").agg(F.count("*").alias("n"))
    return bit_filter(counts.where("n > 1"), "hash", BITS)


def _anchor_rows(docs: DataFrame, originals: np.ndarray, shared: np.ndarray, wanted: np.ndarray | None) -> DataFrame:
    """doc_id, key, hash, digest, start, n: for each shared anchor the strings that have
    it, n from start on, and a digest of the bytes they span; with a filter of the
    places wanted, also these bytes."""
    held = docs.sparkSession.sparkContext.broadcast((shared, wanted, originals))

    def run(batch: pa.RecordBatch):
        batch = batch.filter(pa.array(passes(held.value[2], batch.column(3).to_numpy())))
        data, offsets = text_bytes(batch.column(2))
        for text, hashes, low, high in anchors(data, offsets):
            some = np.flatnonzero(passes(held.value[0], hashes))
            spans = [data[offsets[text[k]] + low[k] : offsets[text[k]] + high[k] + LENGTH].tobytes() for k in some]
            digests = np.array([_digest(s) for s in spans], np.int64)
            ids = batch.column(0).take(pa.array(text[some]))
            if wanted is not None:
                places = place_keys(digests, hashes[some].view(np.int64), ids.fill_null(-1).to_numpy(zero_copy_only=False), low[some])
                hit = np.flatnonzero(passes(held.value[1], places))
                some, digests, spans, ids = some[hit], digests[hit], [spans[k] for k in hit], ids.take(pa.array(hit))
            columns = [ids, batch.column(1).take(pa.array(text[some])), pa.array(hashes[some].view(np.int64)), pa.array(digests), pa.array(low[some]), pa.array((high - low + 1)[some])]
            if wanted is None:
                yield pa.RecordBatch.from_arrays(columns, names)
            else:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, pa.binary())], names)

    names = ["doc_id", "key", "hash", "digest", "start", "n"] + (["bytes"] if wanted is not None else [])
    schema = "doc_id bigint, key bigint, hash bigint, digest bigint, start bigint, n bigint" + (", bytes binary" if wanted is not None else "")
    return arrow_map(docs.select("doc_id", "key", "text", "place"), run, schema)


def place_keys(digest: np.ndarray, hashes: np.ndarray, doc_id: np.ndarray, start: np.ndarray) -> np.ndarray:
    u = lambda x: x.astype(np.int64).view(np.uint64)
    return mix64(mix64(mix64(u(digest) + u(hashes)) + u(doc_id)) + u(start)).view(np.int64)


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or -1. Each place
    asks its neighbour and then who the last answer asked, all places at once."""
    out = np.arange(len(values)) - 1
    todo = np.flatnonzero(out >= 0)
    while len(todo):
        todo = todo[values[out[todo]] >= values[todo]]
        out[todo] = out[out[todo]]
        todo = todo[out[todo] >= 0]
    return out


def repeated_before(windows: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Which strings (rows of LENGTH bytes) start earlier as well, where `position` orders
    the starts and equal positions are not earlier. In suffix order, the nearest string
    before and the nearest after with a smaller position share the longest prefixes with a
    string; its previous factor has LENGTH bytes if either is equal to it."""
    whole = np.ascontiguousarray(windows).view(f"V{LENGTH}").reshape(-1)
    order = np.argsort(np.ascontiguousarray(windows).view(f"S{LENGTH}").reshape(-1), kind="stable")
    p = position[order]
    before = previous_smaller(p)
    after = len(p) - 1 - previous_smaller(p[::-1])[::-1]
    found = np.zeros(len(p), bool)
    for near, some in ((before, before >= 0), (after, after < len(p))):
        at = np.flatnonzero(some)
        found[at] |= whole[order[near[at]]] == whole[order[at]]
    out = np.zeros(len(p), bool)
    out[order] = found
    return out


def _runs(flags: np.ndarray, owner: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first, last) of the runs of set flags along index, within an owner."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (owner[at[1:]] != owner[at[:-1]]) | (index[at[1:]] != index[at[:-1]] + 1)
    first = at[np.flatnonzero(new)]
    last = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1]
    return owner[first], index[first], index[last]


def _spread(spans: list[bytes], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, owner, index): the strings of LENGTH bytes in each span."""
    data = np.frombuffer(b"".join(spans), np.uint8)
    sizes = np.array([len(s) for s in spans])
    owner = np.repeat(np.arange(len(spans)), n)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    rows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[(np.cumsum(sizes) - sizes)[owner] + index]
    return rows, owner, index


def compare_surroundings(rows: DataFrame) -> DataFrame:
    """hash, digest, first, last: the strings (by index in their span) that start earlier
    in another span of the same anchor. Rows are dealt and sorted by anchor, and spans
    go into suffix order some thousand at a time, anchors kept whole."""

    def solve(table: pa.Table):
        n = table["n"].to_numpy()
        windows, owner, index = _spread(table["bytes"].to_pylist(), n)
        doc = table["doc_id"].fill_null(np.iinfo(np.int64).max).to_numpy()[owner]
        missing = table["doc_id"].is_null().to_numpy(zero_copy_only=False)[owner]
        start = table["start"].to_numpy()[owner] + index
        order = np.lexsort((start, doc, missing))
        rank = np.zeros(len(order), np.int64)
        step = (np.diff(start[order]) != 0) | (np.diff(doc[order]) != 0) | (np.diff(missing[order].astype(int)) != 0)
        rank[order] = np.concatenate([[0], np.cumsum(step)]) if len(order) else rank
        own, first, last = _runs(repeated_before(windows, rank), owner, index)
        yield pa.RecordBatch.from_arrays([table["hash"].combine_chunks().take(pa.array(own)), table["digest"].combine_chunks().take(pa.array(own)), pa.array(first), pa.array(last)], ["hash", "digest", "first", "last"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes = batch.column(2).to_numpy()
            cut = int(np.searchsorted(hashes, hashes[-1]))
            if cut:
                yield from solve(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif held and held[-1].column(2)[0].as_py() != hashes[0]:
                yield from solve(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from solve(pa.Table.from_batches(held))

    bound_batches(rows.sparkSession)
    columns = ["doc_id", "start", "hash", "digest", "n", "bytes"]
    return rows.select(*columns).repartition("hash").sortWithinPartitions("hash").mapInArrow(run, "hash bigint, digest bigint, first bigint, last bigint")


def compare_strings(rows: DataFrame) -> DataFrame:
    """The same for anchors with any number of surroundings: each string is a row with two
    64-bit digests, and the earliest of equal ones is found by an aggregation."""

    def run(batch: pa.RecordBatch):
        spans, n = batch.column(5).to_pylist(), batch.column(4).to_numpy()
        _, owner, index = _spread(spans, n)
        two = np.array([[int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)] for o, i in zip(owner, index, strict=True) for d in [hashlib.blake2b(spans[o][i : i + LENGTH], digest_size=16).digest()]], np.int64).reshape(-1, 2)
        take = pa.array(owner)
        yield pa.RecordBatch.from_arrays([pa.array(two[:, 0]), pa.array(two[:, 1]), batch.column(0).take(take), pa.array(batch.column(1).to_numpy()[owner] + index), batch.column(2).take(take), batch.column(3).take(take), pa.array(index)], ["d1", "d2", "doc_id", "start", "hash", "digest", "index"])

    columns = ["doc_id", "start", "hash", "digest", "n", "bytes"]
    strings = write_through(arrow_map(rows.select(*columns), run, "d1 bigint, d2 bigint, doc_id bigint, start bigint, hash bigint, digest bigint, index bigint"), "strings")
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "start")
    earliest = strings.groupBy("d1", "d2").agg(F.min(place).alias("earliest"))
    again = strings.join(earliest, ["d1", "d2"]).where(F.col("earliest") < place)
    return again.select("hash", "digest", F.col("index").alias("first"), F.col("index").alias("last"))


def _earlier(a: str, b: str) -> Column:
    """Whether a doc_id comes before another; null comes last."""
    return F.coalesce(F.col(a) < F.col(b), F.col(a).isNotNull() & F.col(b).isNull())


def repeated_runs(docs: DataFrame) -> DataFrame:
    """doc_id, key, low, high: byte ranges of each text (doc_id, key, text) that strings of
    LENGTH bytes cover which have started before. Ranges may overlap.

    A text that a smaller doc_id has too is all repeated, and its strings are never the
    first ones; it takes no part in the rest. Of anchors with equal surroundings all but
    the first are repeated; only the first of each go into suffix order."""
    docs = docs.withColumn("place", F.xxhash64("doc_id", "key"))
    heads = write_through(docs.select("doc_id", "key", "place", F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("md5"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes")), "document-keys")
    least = heads.groupBy("md5").agg(F.min("doc_id").alias("least"))
    heads = heads.join(least, "md5").withColumn("again", _earlier("least", "doc_id"))
    heads = settle(heads, "document-heads")
    whole = heads.where(F.col("again") & (F.col("bytes") >= LENGTH)).select("doc_id", "key", F.lit(0).cast("long").alias("low"), F.col("bytes").alias("high"))
    originals = bit_filter(heads.where("not again"), "place", BITS)
    shared = shared_anchors(docs, originals)
    found = settle(_anchor_rows(docs, originals, shared, None), "anchors")
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "start")
    spans = settle(found.groupBy("hash", "digest").agg(F.min(place).alias("first"), F.count("*").alias("rows")), "spans")
    kinds = spans.groupBy("hash").agg(F.count("*").alias("kinds"), F.sum("rows").alias("all")).where("all > 1").select("hash", "kinds")
    spans = settle(spans.join(kinds, "hash"), "spans")
    placed = found.join(spans, ["hash", "digest"]).withColumn("copy", F.col("first") < place)
    placed = settle(placed.where("copy or kinds > 1").select("doc_id", "key", "hash", "digest", "start", "n", "copy"), "placed")
    mixed = spans.where("kinds > 1").select("hash", "digest", F.col("first.doc_id").alias("doc_id"), F.col("first.start").alias("start"), "kinds")

    def keys(batch: pa.RecordBatch):
        c = batch.columns
        yield pa.RecordBatch.from_arrays([pa.array(place_keys(c[1].to_numpy(), c[0].to_numpy(), c[2].fill_null(-1).to_numpy(zero_copy_only=False), c[3].to_numpy()))], ["key"])

    wanted = bit_filter(arrow_map(mixed.select("hash", "digest", "doc_id", "start"), keys, "key bigint"), "key", BITS)
    surroundings = _anchor_rows(docs, originals, shared, wanted).select("hash", "digest", "doc_id", "start", "n", "bytes").alias("r")
    same = (F.col("r.hash") == F.col("m.hash")) & (F.col("r.digest") == F.col("m.digest")) & F.col("r.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("r.start") == F.col("m.start"))
    first = settle(surroundings.join(mixed.alias("m"), same).select("r.*", "m.kinds"), "surroundings")
    inner = compare_surroundings(first.where(F.col("kinds") <= CROWD)).unionByName(compare_strings(first.where(F.col("kinds") > CROWD)))
    inner = settle(inner, "repeated-strings").distinct()
    copies = placed.where("copy").select("doc_id", "key", F.col("start").alias("low"), (F.col("start") + F.col("n") + LENGTH - 1).alias("high"))
    parts = placed.where("not copy").join(inner, ["hash", "digest"]).select("doc_id", "key", (F.col("start") + F.col("first")).alias("low"), (F.col("start") + F.col("last") + LENGTH).alias("high"))
    return whole.unionByName(copies).unionByName(parts)


def merge_ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges, as ranges that neither overlap nor touch."""
    if not len(low):
        return low, high
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    new = np.ones(len(low), bool)
    new[1:] = low[1:] > high[:-1]
    first = np.flatnonzero(new)
    return low[first], high[np.append(first[1:], len(low)) - 1]


def with_ranges(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and more) with `lows` and `highs` of what is to be removed; null
    where nothing is."""
    keyed = docs.withColumn("__key", F.xxhash64("text"))
    ranges = repeated_runs(keyed.select("doc_id", F.col("__key").alias("key"), "text"))
    lists = settle(ranges.groupBy("doc_id", "key").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs")), "ranges")
    lists = lists.withColumnsRenamed({"doc_id": "__id", "key": "__with"})
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__with"))
    return keyed.join(lists, same, "left").drop("__key", "__with", "__id")


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (binary) of
    every document.

    Earlier means a smaller doc_id, or the same and an earlier start; rows that repeat in
    doc_id and text do not remove each other, and null doc_ids come last, all as one
    document. Null text counts as empty; texts shorter than LENGTH keep all; an empty
    table gives no rows; other columns are ignored."""

    def run(batch: pa.RecordBatch):
        data, offsets = text_bytes(batch.column(1))
        counts, removed, spans, digests, kept = [], [], [], [], []
        for i in range(batch.num_rows):
            text = data[offsets[i] : offsets[i + 1]]
            lows, highs = batch.column(2)[i].values, batch.column(3)[i].values
            n = 0
            if lows is not None and len(lows):
                low, high = merge_ranges(lows.to_numpy(), highs.to_numpy())
                n = len(low)
                text = np.concatenate([text[a:b] for a, b in zip(np.append(0, high), np.append(low, len(text)), strict=True)])
            counts.append(int(offsets[i + 1] - offsets[i]))
            removed.append(counts[-1] - len(text))
            spans.append(n)
            kept.append(text.tobytes())
            digests.append(hashlib.sha256(kept[-1]).hexdigest())
        columns = [batch.column(0), *[pa.array(x, pa.int64()) for x in (counts, removed, spans)], pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary())][: len(names)], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if with_text else 5]
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if with_text else "")
    return arrow_map(with_ranges(docs.select("doc_id", "text")).select("doc_id", "text", "lows", "highs"), run, schema)
