"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from every learning document. Weights are learnt on a bounded
sample with follow-the-regularised-leader updates, whose L1 and L2 penalties keep them
sparse, and probabilities are calibrated by a temperature on a part kept aside."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, bound_batches

#: n-grams of 1 to ORDERS characters are hashed to so many features
FEATURES = 1 << 15
ORDERS = 3
#: about so many documents of each language are learnt from
PER_LANGUAGE = 500
PASSES = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
#: this share of the sample only sets the temperature
KEPT_ASIDE = 0.2
UNKNOWN = "und"
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def _letters() -> np.ndarray:
    table = np.ones(0x110000, bool)
    table[:0x10000] = [chr(i).isalpha() for i in range(0x10000)]
    return table


_LETTER: np.ndarray | None = None


def has_letter(text: str) -> bool:
    """Letters proper; numbers that are written as letters or signs are none."""
    return any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """The feature of every n-gram of the text in lower case, where what lies between
    letters counts as one space."""
    global _LETTER
    if _LETTER is None:
        _LETTER = _letters()
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
    letter = _LETTER[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.where(letter, codes, np.uint32(32))[keep]
    if len(codes) and codes[0] != 32:
        codes = np.concatenate([[np.uint32(32)], codes])
    found, gram = [], np.zeros(len(codes), np.uint32)
    for k in range(min(ORDERS, len(codes))):
        gram = gram[: len(codes) - k] + codes[k:] * MULTIPLIERS[k]
        mixed = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x2C1B3C6D + 2 * k)
        found.append(mixed >> np.uint32(32 - FEATURES.bit_length() + 1))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def vector(text: str, idf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The features of a text and their weights (1 + ln count) * idf, of length 1."""
    counts = np.bincount(features(text), minlength=FEATURES)
    index = np.flatnonzero(counts)
    value = 1.0 + np.log(counts[index])
    if idf is not None:
        value = value * idf[index]
        value /= np.sqrt((value * value).sum()) or 1.0
    return index.astype(np.int32), value


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    idf: np.ndarray = field(default_factory=lambda: np.ones(FEATURES, np.float32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, FEATURES + 1), np.float32))
    temperature: float = 1.0

    def logits(self, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        return self.weights[:, index] @ value + self.weights[:, FEATURES]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*vector(text, self.idf)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(min(1.0, p[best]))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(samples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, seed: int = 7) -> np.ndarray:
    """Weights (classes x features and a bias) after PASSES over the samples in a shuffled
    order. A weight is 0 while the sum of its adjusted gradients stays within L1."""
    z, n = np.zeros((classes, FEATURES + 1)), np.zeros((classes, FEATURES + 1))

    def weights(at) -> np.ndarray:
        zz, nn = z[:, at], n[:, at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(nn)) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(PASSES):
        for i in rng.permutation(len(samples)):
            index, value, y = samples[i]
            at, x = np.append(index, FEATURES), np.append(value, 1.0)
            w = weights(at)
            error = softmax(w @ x)
            error[y] -= 1.0
            g = error[:, None] * x[None, :]
            before = n[:, at]
            z[:, at] += g - (np.sqrt(before + g * g) - np.sqrt(before)) / ALPHA * w
            n[:, at] = before + g * g
    return weights(slice(None)).astype(np.float32)


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the highest likelihood of y, by a search that halves its steps."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean())

    at, step = 0.0, 2.0
    while step > 0.01:
        at = min((at - step, at, at + step), key=loss)
        step /= 2
    return float(np.exp(np.clip(at, -4, 4)))


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """How many of the texts there are, and how many hold each feature. Each task adds up
    what it reads and gives a row for each feature."""

    def count(batches):
        total, held = 0, np.zeros(FEATURES, np.int64)
        for batch in batches:
            for text in batch.column(0):
                flags = np.zeros(FEATURES, bool)
                flags[features(text.as_py() or "")] = True
                held += flags
                total += 1
        index = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(index, -1).astype(np.int32)), pa.array(np.append(held[index], total))], ["feature", "n"])

    bound_batches(texts.sparkSession)
    rows = texts.mapInArrow(count, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    held, total = np.zeros(FEATURES), 0
    for r in rows:  # FEATURES + 1 rows at most
        if r["feature"] < 0:
            total = r["n"]
        else:
            held[r["feature"]] = r["n"]
    return total, held


def learn(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model from (key, text, lang). About per_language documents of each language,
    chosen by a hash of key, are learnt from; frequencies come from all of them."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model()
    languages = sorted(sizes)
    total, held = document_frequencies(labelled.select("text"))
    model = Model(languages, (np.log((1 + total) / (1 + held)) + 1).astype(np.float32))
    share = labelled.sparkSession.createDataFrame([(s, min(1.0, per_language / n)) for s, n in sizes.items()], "lang string, share double")
    draw = F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.join(F.broadcast(share), "lang").where(draw < F.col("share")).select("lang", "text", F.xxhash64("key", F.lit(12)).alias("place"))

    def vectors(batch: pa.RecordBatch):
        pairs = [vector(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([p[0] for p in pairs], pa.list_(pa.int32())), pa.array([p[1].astype(np.float32) for p in pairs], pa.list_(pa.float32()))], ["lang", "place", "index", "value"])

    rows = sorted(arrow_map(chosen, vectors, "lang string, place bigint, index array<int>, value array<float>").toArrow().to_pylist(), key=lambda r: (r["place"], r["lang"], len(r["index"]), r["index"]))
    samples = []
    for r in rows:
        index = np.array(r["index"], np.int32)
        value = np.array(r["value"]) * model.idf[index]
        samples.append((index, value / (np.sqrt((value * value).sum()) or 1.0), languages.index(r["lang"])))
    aside = int(len(samples) * KEPT_ASIDE) if len(samples) >= 20 else 0
    model.weights = ftrl(samples[aside:], len(languages))
    held_back = samples[:aside]
    if aside:
        model.temperature = best_temperature(np.array([model.logits(i, v) for i, v, _ in held_back]), np.array([y for _, _, y in held_back]))
    return model


def predict(texts: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns in keep, lang_pred and score of each row's whole text. The model has
    FEATURES weights for each language and is sent to the tasks."""
    held = texts.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        found = [held.value.predict(t.as_py()) for t in batch.column(len(keep))]
        yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*keep, "lang_pred", "score"])

    kinds = dict(texts.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "lang_pred string", "score double"])
    return arrow_map(texts.select(*keep, "text"), run, schema)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo the folds; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    Learns from documents whose fold of 4 is not 2, with a language and a text; a null
    doc_id has no fold, is not held out and not learnt from. Text that is null or has no
    letter is `und` with score 0, and so is every text if there is nothing to learn from.
    Of equal probabilities the first language by name wins. Repeated rows are predicted
    each; texts of any length are read whole; an empty table gives no rows; other columns
    are ignored."""
    rows = docs.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "text", "lang")
    learning = rows.where(~F.col("held_out") & F.col("doc_id").isNotNull())
    model = learn(learning.select(F.col("doc_id").alias("key"), "text", "lang"))
    return predict(rows, model, ["doc_id", "held_out"])
