import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palisade.llm import language_id, quality_classifier


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.fixture(scope="module")
def middle(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_languages_of_held_out_documents(middle):
    got = language_id.identify(middle).join(middle.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == middle.count() and all(r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)


def test_penalties_leave_few_weights_and_temperature_calibrates(middle):
    model = language_id.learn(middle.select(F.col("doc_id").alias("key"), "text", "lang"))
    assert 0 < (model.weights != 0).mean() < 0.5 and 0.01 < model.temperature < 60


def test_best_temperature():
    rng = np.random.default_rng(1)
    logits = rng.normal(0, 2, (4000, 3))
    p = language_id.softmax(logits / 2.5)
    y = np.array([rng.choice(3, p=x) for x in p])
    assert abs(language_id.best_temperature(logits, y) - 2.5) < 0.4


def test_language_of_odd_rows(odd, none):
    got = language_id.identify(odd).collect()
    assert len(got) == odd.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (3, 4, 5, 7))
    assert all(r["lang_pred"] in ("en", "de") for r in got if r["doc_id"] in (1, 8, 10))
    assert language_id.identify(none).collect() == []
    assert {r["lang_pred"] for r in language_id.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_quality_of_held_out_documents(spark, middle):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_classifier.classify(middle, labels).join(labels, "doc_id", "left").collect()
    assert len(got) == middle.count()
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["quality"] is not None]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.93 * len(held)


def test_sum_of_squares_equals_all_pairs():
    rng = np.random.default_rng(2)
    texts = pa.array(["one two two three", "", None, "Four five SIX six! 7 <8>"])
    structure, at, word, value = quality_classifier.batch_features(texts, np.array([17.0, 0.0, -1.0, 24.0]))
    words, size = 1 << quality_classifier.WORD_BITS, (1 << quality_classifier.WORD_BITS) + len(quality_classifier.STRUCTURE)
    m = quality_classifier.Machine(0.1, rng.normal(0, 1, size), rng.normal(0, 1, (size, 4)), structure.mean(axis=0), np.ones(structure.shape[1]))
    got = m.score(structure, at, word, value)
    dense = m.standard(structure)
    for i in range(4):
        index = np.concatenate([word[at == i], np.arange(words, size)])
        x = np.concatenate([value[at == i], dense[i]])
        total = m.bias + m.weights[index] @ x
        for a in range(len(x)):
            for b in range(a):
                total += m.factors[index[a]] @ m.factors[index[b]] * x[a] * x[b]
        assert abs(got[i] - 1 / (1 + np.exp(-total))) < 1e-9


def test_quality_scores_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (7, 0, 1), (None, 1, 0), (8, None, None), (99, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = quality_classifier.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality_classifier.classify(none, labels).collect() == []
    assert quality_classifier.classify(odd, labels.limit(0)).count() == odd.count()


def test_numbers_that_look_like_letters_name_no_language(spark, small):
    from palisade.llm import language_id

    odd = [(-1, "\u00b2"), (-2, "\u00bd \u2460 \u2167"), (-3, "12 !"), (-4, None), (-5, ""), (-6, "\u00b2 der Hund"), (-7, "\U0001f600")]
    docs = small.select("doc_id", "text", "lang").union(spark.createDataFrame([(i, t, None) for i, t in odd], "doc_id bigint, text string, lang string"))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs).where("doc_id < 0").collect()}
    assert {i for i, (lang, score) in got.items() if (lang, score) == ("und", 0.0)} == {-1, -2, -3, -4, -5, -7}
    assert got[-6][0] != "und"
