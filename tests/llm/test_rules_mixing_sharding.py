import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from palisade.llm import mixing, quality_rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def base_values(text):
    w = words(text)
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = {}
    for x in wins:
        seen[x] = seen.get(x, 0) + 1
    covered = {j for i, x in enumerate(wins) if seen[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_base_values(spark, odd):
    extra = ["a b c d e f g h " * 3, "a b c d e f g h i a b c d e f g h", "ä # * $ % & | < > é\n\r\n x\n x\n\x85y", "p q " * 20 + "r s t u v w x y z " * 2]
    docs = odd.select("doc_id", "text", "lang", "source").union(spark.createDataFrame([(100 + i, t, "en", "a") for i, t in enumerate(extra)], "doc_id bigint, text string, lang string, source string"))
    rows = docs.collect()
    got = quality_rules.quality_rules(docs).collect()
    want = sorted((r["doc_id"] if r["doc_id"] is not None else -1, *base_values(r["text"])) for r in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, *[r[c] for c in quality_rules.BASE]) for r in got) == want
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got)


def test_quality_of_odd_tables(odd, none):
    assert quality_rules.quality_rules(none).collect() == []
    kept = quality_rules.keep_good(odd)
    assert kept.columns == odd.columns and kept.count() <= odd.count()


def test_sketches_merge_and_bound_quantiles(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 5000, 4000)
    rows = [("en", f"s{i % 4}", "word_length", int(v)) for i, v in enumerate(values)]
    cut = F.greatest(F.lit(0), F.length(F.bin("v")) - quality_rules.BITS)
    binned = spark.createDataFrame(rows, "lang string, source string, measure string, v bigint").withColumn("cut", cut).withColumn("bin", F.expr("shiftleft(shiftright(v, cut), cut)"))
    fine = binned.groupBy("lang", "source", "measure", "bin").agg(F.count("*").alias("n"))
    got = quality_rules.quantiles(quality_rules.merge(fine, ["lang"]), ["lang"]).first()
    ordered = np.sort(values)
    for name, q in (("q250", 0.25), ("q500", 0.5), ("q750", 0.75), ("q990", 0.99)):
        true = ordered[int(np.ceil(q * len(ordered))) - 1]
        assert true * 127 / 128 - 1 <= got[name] <= true


def measured(spark, rows):
    """Documents as measure gives them: (lang, source, word_length, symbol_rate, dup_line_rate, repeat_rate)."""
    table = [(i, *r, False) for i, r in enumerate(rows)]
    return spark.createDataFrame(table, "doc_id bigint, lang string, source string, word_length bigint, symbol_rate bigint, dup_line_rate bigint, repeat_rate bigint, base_failed boolean")


def fences_of(spark, rows):
    return {(r["lang"], r["source"]): r for r in quality_rules.thresholds(quality_rules.sketch(measured(spark, rows))).collect()}


def test_fences_follow_their_source(spark):
    prose = [("en", "prose", 480 + i % 41, 0, 0, 0) for i in range(380)] + [("en", "prose", 500, 450 + i, 0, 0) for i in range(20)]
    code = [("en", "code", 600 + i % 201, 250 + i % 401, 0, 0) for i in range(400)]
    got = fences_of(spark, prose + code)
    a, b = got["en", "prose"], got["en", "code"]
    # the same symbols pass in one source and not in the other, so no fixed cutoff gives both verdicts
    assert a["symbol_rate_upper"] < 450 < b["symbol_rate_upper"]
    assert a["word_length_upper"] < 800 < b["word_length_upper"] and a["word_length_lower"] > 300
    verdicts = quality_rules.judge(measured(spark, prose + code), quality_rules.thresholds(quality_rules.sketch(measured(spark, prose + code)))).groupBy("source", "kept").count().collect()
    assert {(r["source"], r["kept"]): r["count"] for r in verdicts} == {("prose", True): 380, ("prose", False): 20, ("code", True): 400}


def test_fences_without_spread(spark):
    lines = [("en", "a", 500 + i % 9, i % 2 if i % 20 == 0 else 0, 50 + i % 120 if i % 3 == 0 else 0, 0) for i in range(600)]
    copies = [("en", "copies", 507, 0, 0, 0) for _ in range(300)]
    got = fences_of(spark, lines + copies + [("fr", None, 900, 0, 0, 0)])
    a, b, c = got["en", "a"], got["en", "copies"], got["fr", None]
    assert 170 < a["dup_line_rate_upper"] < 1000 and a["symbol_rate_upper"] == quality_rules.NO_FENCE
    # a source of copies takes the spread of its language, a small group that of all documents
    assert b["word_length_upper"] - b["word_length_lower"] > 2 * quality_rules.REACH and c["word_length_upper"] < 900
    assert b["repeat_rate_upper"] == quality_rules.NO_FENCE


def test_stray_symbols_do_not_stand_apart(spark):
    rows = [("en", "a", 500 + i % 9, 0 if i % 10 else i % 7, 0, 0) for i in range(970)] + [("en", "a", 500, 900, 0, 0) for _ in range(30)]
    assert 7 < fences_of(spark, rows)["en", "a"]["symbol_rate_upper"] < 900


def test_targets():
    assert mixing.weights_in_order(["b", None, "a", "", "é"]) == {"": 1, "a": 2, "b": 3, "é": 1, None: 2}
    got = mixing.targets({"a": 100, "b": 1, "c": 100}, {"a": 1, "b": 2, "c": 3})
    assert got["b"] == 3 and abs(sum(got.values()) - 201) < 1e-9 and abs(got["c"] / got["a"] - 3) < 1e-9
    assert mixing.targets({"a": 0, None: 0}, {"a": 1, None: 2}) == {"a": 0, None: 0} and mixing.targets({}, {}) == {}


def test_draws_meet_budgets_and_permutations_are_permutations():
    budget = np.array([0, 5, 1000, 123456])
    counts = mixing.draw_counts(budget, 16, 1)
    assert (counts.sum(axis=0) == budget).all() and (counts == mixing.draw_counts(budget, 16, 1)).all()
    assert counts.sum(axis=1).max() - counts.sum(axis=1).min() <= 1
    for n in (1, 2, 3, 17, 256, 1000):
        for seed in (1, 2):
            got = mixing.permute(np.arange(n), np.full(n, n), np.full(n, seed))
            assert sorted(got) == list(range(n))


def check_mix(rows, got):
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
    goal = mixing.targets(sizes, mixing.weights_in_order(sizes))
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - goal[r["source"]]) < 1e-6 and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 1.5 * mixing.BLOCK_WORDS for s in sizes)


def test_mix(spark, small, odd, none):
    for docs in (small, odd):
        got = mixing.mix_documents(docs).collect()
        assert len(got) == docs.count()
        check_mix(docs.collect(), got)
    again = lambda df: sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in df.collect())
    assert again(mixing.mix_documents(small)) == again(mixing.mix_documents(small.repartition(7)))
    assert mixing.mix_documents(none).collect() == []


def test_mixed_texts_hold_what_is_taken(small):
    taken = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix_documents(small).collect()}
    original = {r["doc_id"]: r["text"] for r in small.collect()}
    sums = {}
    for r in mixing.mixed_texts(small).collect():
        n = len(words(r["text"]))
        sums[r["doc_id"]] = sums.get(r["doc_id"], 0) + n
        assert r["n_chars"] == len(r["text"]) and (n < taken[r["doc_id"]][0] or r["text"] == original[r["doc_id"]])
    goal = sum(t for _, t in taken.values())
    assert abs(sum(sums.values()) - goal) <= 64 * 3 * 25


def test_rendezvous_moves_only_into_the_new_shard(spark, small, odd):
    for docs in (small, odd):
        got = sharding.shard_documents(docs).collect()
        assert len(got) == docs.count()
        assert all(r["grown_shard"] in (r["shard"], 8) and 0 <= r["shard"] < 8 for r in got)
        for s in range(8):
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    texts = {(r["doc_id"], zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 1) for r in odd.collect()}
    assert {(r["doc_id"], r["text_crc32"], r["size"]) for r in got} == texts


def test_weights_set_the_shares(spark):
    got = sharding.assign(spark.range(20000), "id", {0: 1.0, 1: 3.0, 2: 0.0, 5: 1.0}).groupBy("shard").count().collect()
    share = {r["shard"]: r["count"] / 20000 for r in got}
    assert set(share) == {0, 1, 5} and abs(share[1] - 0.6) < 0.02 and abs(share[0] - 0.2) < 0.02


def test_mixed_texts_of_repeated_rows(spark):
    """Rows repeated in all columns are drawn each: as many words come out as the mix of
    the documents takes, and nothing of another text."""
    rows = [(1, "alpha beta " * 40, "en", "a", 1)] * 30 + [(i, f"w{i} " * 50, "en", "b" if i % 2 else None, i) for i in range(2, 60)] + [(99, None, "en", "a", 0), (98, "", "en", "c", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(5)
    taken = {}
    for r in mixing.mix_documents(docs).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    got = {}
    for r in mixing.mixed_texts(docs).collect():
        words = r["text"].split()
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(words)
        assert set(words) <= ({"alpha", "beta"} if r["doc_id"] == 1 else {f"w{r['doc_id']}"}) and r["n_chars"] == len(r["text"])
    per_source = lambda found: {s: sum(n for d, n in found.items() if (1 if d == 1 else 2 + d % 2) == s) for s in (1, 2, 3)}
    assert per_source(got) == per_source(taken)
