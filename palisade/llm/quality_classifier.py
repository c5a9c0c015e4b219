"""A quality score by a factorisation machine over hashed words, structure statistics and
metadata. Pairwise interactions of all features are scored in linear time:
sum over i<j of <v_i, v_j> x_i x_j = (|sum v_i x_i|^2 - sum |v_i x_i|^2) / 2."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import BYTE, arrow_map, span_hashes, text_bytes, window_hashes, word_spans
from .language_id import fold

WORD_BITS = 15
FACTORS = 8
#: about so many labelled rows are learnt from
SAMPLE = 6000
PASSES = 12
BATCH = 64
RATE, PENALTY = 0.1, 2e-4
THRESHOLD = 0.3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_BYTE = BYTE[_LOWER]
_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&|<>", "shout": b"!?", "stop": b".,;:", "break": b"\n", "space": b" \t", "quote": b"\"'()[]{}=_/\\"}
STRUCTURE = [*_KINDS, "beyond_ascii", "log_words", "word_bytes", "distinct", "top_word", "windows", "log_chars", "chars_known"]


def batch_features(texts: pa.Array, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(structure, document, word, value): structure statistics of each text of a batch,
    and its distinct hashed words with the value ln(1 + count), of length 1 in each text.
    n_chars is metadata, below 0 where unknown."""
    data, offsets = text_bytes(texts)
    n, size = len(texts), np.maximum(np.diff(offsets), 1)
    out = np.zeros((n, len(STRUCTURE)))

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    for k, members in enumerate(_KINDS.values()):
        table = np.zeros(256, bool)
        table[list(members)] = True
        out[:, k] = per_text(table[data]) / size
    starts, ends, first = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends, _LOWER_BYTE)
    words = np.diff(first)
    document = np.repeat(np.arange(n), words)
    key, counts = np.unique((document.astype(np.uint64) << np.uint64(WORD_BITS)) | (hashes >> np.uint64(64 - WORD_BITS)), return_counts=True)
    at, word = (key >> np.uint64(WORD_BITS)).astype(np.int64), (key & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
    value = np.log1p(counts)
    value /= np.sqrt(np.bincount(at, value * value, n))[at]
    k = len(_KINDS)
    some = np.maximum(words, 1)
    out[:, k] = per_text(data >= 128) / size
    out[:, k + 1] = np.log1p(words)
    out[:, k + 2] = np.bincount(document, ends - starts, n) / some
    out[:, k + 3] = np.bincount(at, minlength=n) / some
    top = np.zeros(n)
    np.maximum.at(top, at, counts)
    out[:, k + 4] = top / some
    windows = window_hashes(hashes, 4)
    if len(windows):
        inside = document[: len(windows)] == document[3:]
        own = document[: len(windows)][inside]
        distinct = np.unique(windows[inside] ^ (own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
        out[:, k + 5] = np.bincount(own[distinct], minlength=n) / np.maximum(np.bincount(own, minlength=n), 1)
    out[:, k + 6] = np.log1p(np.maximum(n_chars, 0))
    out[:, k + 7] = n_chars >= 0
    return out, at, word, value


@dataclass
class Machine:
    """bias, weights and factors; words come first, then the structure statistics, which
    are centred, scaled and cut to [-3, 3]."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray

    def standard(self, structure: np.ndarray) -> np.ndarray:
        return np.clip((structure - self.centre) / self.scale, -3, 3) / np.sqrt(structure.shape[1])

    def score(self, structure: np.ndarray, at: np.ndarray, word: np.ndarray, value: np.ndarray) -> np.ndarray:
        n, dense = len(structure), self.standard(structure)
        words = 1 << WORD_BITS
        linear = self.bias + np.bincount(at, self.weights[word] * value, n) + dense @ self.weights[words:]
        both = np.zeros(n)
        for f in range(self.factors.shape[1]):
            v = self.factors[word, f] * value
            own = dense * self.factors[words:, f]
            total = np.bincount(at, v, n) + own.sum(axis=1)
            both += total * total - np.bincount(at, v * v, n) - (own * own).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(linear + both / 2, -30, 30)))


def train(structure: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 5) -> Machine:
    """Mini-batches with adaptive steps on the logistic loss."""
    rng, words = np.random.default_rng(seed), 1 << WORD_BITS
    size = words + len(STRUCTURE)
    scale = structure.std(axis=0) if len(y) else np.ones(len(STRUCTURE))
    machine = Machine(0.0, np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)), structure.mean(axis=0) if len(y) else np.zeros(len(STRUCTURE)), np.where(scale > 1e-9, scale, 1.0))
    if not len(y):
        return machine
    share = float(np.clip(y.mean(), 0.01, 0.99))
    machine.bias = float(np.log(share / (1 - share)))
    dense = machine.standard(structure)
    seen_w, seen_v, seen_b = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
    for _ in range(PASSES):
        for rows in np.array_split(rng.permutation(len(y)), -(-len(y) // BATCH)):
            at = np.repeat(np.arange(len(rows)), [len(lists[r][0]) + len(STRUCTURE) for r in rows])
            feature = np.concatenate([np.append(lists[r][0], np.arange(words, size)) for r in rows])
            x = np.concatenate([np.append(lists[r][1], dense[r]) for r in rows])
            v = machine.factors[feature] * x[:, None]
            total = np.stack([np.bincount(at, v[:, f], len(rows)) for f in range(FACTORS)], axis=1)
            logit = machine.bias + np.bincount(at, machine.weights[feature] * x, len(rows)) + (total**2 - np.stack([np.bincount(at, v[:, f] ** 2, len(rows)) for f in range(FACTORS)], axis=1)).sum(axis=1) / 2
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[rows]) / len(rows)
            used, place = np.unique(feature, return_inverse=True)
            each = error[at] * x
            gw = np.bincount(place, each, len(used)) + PENALTY * machine.weights[used]
            gv = np.stack([np.bincount(place, each * (total[at, f] - v[:, f]), len(used)) for f in range(FACTORS)], axis=1) + PENALTY * machine.factors[used]
            gb = error.sum()
            seen_b += gb * gb
            seen_w[used] += gw * gw
            seen_v[used] += gv * gv
            machine.bias -= RATE * gb / np.sqrt(seen_b)
            machine.weights[used] -= RATE * gw / np.sqrt(seen_w[used])
            machine.factors[used] -= RATE * gv / np.sqrt(seen_v[used])
    return machine


def _known(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64(), safe=False).fill_null(-1.0).to_numpy(zero_copy_only=False)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """A machine from (doc_id, quality) of labels and (doc_id, text, n_chars) of docs.
    About `sample` labelled rows, chosen by a hash of doc_id, are learnt from; they are
    few enough to be broadcast."""
    labels = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    total = labels.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(21)), F.lit(1 << 30)) / float(1 << 30)
    chosen = labels.where(draw < (min(1.0, sample / total) if total else 0.0)).select(F.col("doc_id").alias("labelled"), F.col("quality").cast("double").alias("y"))
    rows = docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["labelled"]).select("y", "text", "n_chars", F.xxhash64("doc_id", F.lit(22)).alias("place"))

    def features(batch: pa.RecordBatch):
        structure, at, word, value = batch_features(batch.column(1), _known(batch.column(2)))
        cuts = np.searchsorted(at, np.arange(1, batch.num_rows))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(3), pa.array(list(structure), pa.list_(pa.float64())), pa.array(np.split(word.astype(np.int32), cuts), pa.list_(pa.int32())), pa.array(np.split(value.astype(np.float32), cuts), pa.list_(pa.float32()))],
            ["y", "place", "structure", "word", "value"],
        )

    found = arrow_map(rows, features, "y double, place bigint, structure array<double>, word array<int>, value array<float>").toArrow().to_pylist()
    found.sort(key=lambda r: (r["place"], r["y"], r["word"]))
    structure = np.array([r["structure"] for r in found]).reshape(len(found), len(STRUCTURE))
    return train(structure, [(np.array(r["word"], np.int64), np.array(r["value"], np.float64)) for r in found], np.array([r["y"] for r in found]))


def score(docs: DataFrame, machine: Machine, keep: list[str]) -> DataFrame:
    """The columns in keep and the score of each whole text. The machine has a fixed size."""
    held = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batch: pa.RecordBatch):
        k = len(keep)
        found = held.value.score(*batch_features(batch.column(k), _known(batch.column(k + 1))))
        yield pa.RecordBatch.from_arrays([*batch.columns[:k], pa.array(found)], [*keep, "score"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "score double"])
    return arrow_map(docs.select(*keep, "text", "n_chars"), run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Learns from labels whose fold of 5 is not 0; a null doc_id has no fold, is not held
    out and has no label. Null text counts as empty and is scored like any other; without
    labels every score is near a half. Repeated rows are scored each; a document with two
    labels is learnt twice; other columns are ignored."""
    fold_is_0 = lambda df: F.coalesce(fold(df["doc_id"], 5) == 0, F.lit(False))
    rows = docs.select("doc_id", fold_is_0(docs).alias("held_out"), "text", "n_chars")
    machine = learn(rows, labels.where(~fold_is_0(labels)).select("doc_id", "quality"))
    return score(rows, machine, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
