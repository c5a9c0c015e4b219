import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from palisade.llm import components, jaccard_join, suffix_dedup


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    smallest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            smallest[root(i)] = min(d, smallest.get(root(i), d))
    return sorted(((d if d is not None else -1), len(sets[i]), smallest.get(root(i), -1)) for i, (d, _) in enumerate(rows))


def answer(docs):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1) for r in jaccard_join.near_duplicates(docs).collect())


def variants(seed, groups, size, words):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(words)]
        for _ in range(size):
            text = list(base)
            for _ in range(rng.randrange(0, max(2, words // 25))):
                k = rng.randrange(len(text))
                text[k : k + rng.randrange(2)] = [f"x{rng.randrange(9999)}"] * rng.randrange(2)
            rows.append((len(rows) * 3 % 1009 + 2000 * g, " ".join(text)))
    return rows


def test_components_equal_brute_force(spark, small, odd):
    for rows in (variants(1, 6, 15, 60), variants(2, 3, 30, 120), [(r["doc_id"], r["text"]) for r in odd.collect()], [(r["doc_id"], r["text"]) for r in small.collect()]):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
        assert answer(docs) == brute_components(rows)


def test_shared_passage_and_large_group(spark):
    """Many texts with one common passage, and a group larger than the limit for frequent
    shingles, whose members differ by a word or two."""
    rng = random.Random(4)
    common = " ".join(f"c{i}" for i in range(12))
    rows = [(i, common + " " + " ".join(f"u{i}n{k}" for k in range(30))) for i in range(120)]
    base = [f"g{i}" for i in range(50)]
    for i in range(150):
        text = list(base)
        text[rng.randrange(50)] = f"v{rng.randrange(40)}"
        rows.append((1000 + i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert answer(docs) == brute_components(rows)


def test_frequent_shingles_are_counted_packed(spark, monkeypatch):
    """Every shingle of every text is counted, also where one batch or several hold it just
    often enough, but a batch of texts is shuffled as a row a part."""
    monkeypatch.setattr(jaccard_join, "PARTS", 1 << 4)
    rare, often = [f"r{i} a b c d" for i in range(50)], [f"f{i} a b c d" for i in range(50)]
    texts = [t for t in rare for _ in range(jaccard_join.FREQUENT)] + [t for t in often for _ in range(jaccard_join.FREQUENT + 1)]
    texts += ["always a b c d"] * 1500 + [" ".join(f"l{i}" for i in range(5000)), None, "", " "]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    token = lambda t: jaccard_join.shingle_sets(pa.array([t]))[0]
    held = jaccard_join.frequent_shingles(docs)
    assert all(jaccard_join.passes(held, token(t)).all() for t in [*often, "always a b c d"])
    assert not any(jaccard_join.passes(held, token(t)).any() for t in rare)
    dealt = jaccard_join.dealt_shingles(docs).collect()
    assert len(dealt) <= 16 * 12 and sum(len(r["tokens"]) for r in dealt) <= 4 * (5000 + 50 * 64 + 50 * 65 + 65 * 12)
    assert not jaccard_join.frequent_shingles(docs.limit(0)).any() and not jaccard_join.frequent_shingles(docs.where("text is null")).any()


def test_only_sets_that_may_be_similar_are_written(spark, monkeypatch):
    """Texts that share a first shingle meet; the shingles of those whose sizes or bitmaps
    rule each other out are never written."""
    written = {}

    def settle(df, label, real=jaccard_join.settle):
        out = real(df, label)
        written[label] = written.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(jaccard_join, "settle", settle)
    rows = [(i, " ".join([f"s{i // 2}n{k}" for k in range(18)] + [f"u{i}n{k}" for k in range(16)])) for i in range(80)]
    rows += [(1000, "a b c d e f g h i j k l m n"), (1001, "a b c d e f g h i j k l m n o")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert answer(docs) == brute_components(rows)
    assert written["first-shingles"] == 82 and 0 < written["meetings"] and written["sets"] <= 20


def test_prefixes_meet_and_bitmaps_bound():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        x = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        cut = rng.integers(0, max(1, len(x) // 6) + 1)
        y = np.unique(np.concatenate([x[cut:], rng.integers(-(1 << 62), 1 << 62, rng.integers(0, max(1, len(x) // 6) + 1))]))
        if not len(y):
            continue
        both, union = len(np.intersect1d(x, y)), len(np.union1d(x, y))
        similar = 5 * both >= 4 * union
        assert jaccard_join.linked(x, y) == similar
        late = np.zeros(1 << 21, np.uint8)
        late[rng.integers(0, 1 << 21, 1 << 20)] = 255
        for frequent in (np.zeros(1 << 21, np.uint8), late):
            meet = set(jaccard_join.prefix(x, frequent)[0]) & set(jaccard_join.prefix(y, frequent)[0])
            assert meet or not similar
        assert jaccard_join.may_link(len(x), len(y), jaccard_join.bitmap(x), jaccard_join.bitmap(y)) or not similar


def test_ranks_let_similar_sets_pass(spark):
    """No similar pair is ruled out by the ranks of its first common shingle, and a set
    whose ranks are too late meets no larger one."""
    rng, rows, want = np.random.default_rng(8), [], []
    for _ in range(400):
        x = rng.permutation(200)[: int(rng.integers(2, 120))]
        y = np.concatenate([x[rng.random(len(x)) > 0.08], 200 + np.arange(int(rng.integers(0, 12)))])
        x, y = sorted(x.tolist()), sorted(y.tolist())
        both = set(x) & set(y)
        if both:
            rows.append((len(x), x.index(min(both)), len(y), y.index(min(both))))
            want.append(5 * len(both) >= 4 * len(set(x) | set(y)))
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n bigint, r bigint, m bigint, q bigint")
    got = got.withColumn("near", jaccard_join.may_reach(*[got[c] for c in "nrmq"])).orderBy("i").collect()
    assert any(want) and all(g["near"] for g, w in zip(got, want, strict=True) if w)
    for (n, r, m, q), w in zip(rows, want, strict=True):
        k, rank = min((n, r), (m, q))
        assert not w or 9 * (k - rank) >= 8 * k


def test_one_of_each(odd, none):
    stay = jaccard_join.one_of_each(odd)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in stay.collect())
    assert stay.columns == odd.columns and got == sorted([1, 3, 4, 5, 6, 7, 8, 9, -1, 10, 10])
    assert jaccard_join.one_of_each(none).collect() == [] and jaccard_join.near_duplicates(none).collect() == []


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200, 0, -1)] + [(500, 501), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 202)}, 500: 500, 501: 500}


def brute_removal(rows, length=100):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) by looking at every string."""
    first = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    place = lambda d, i: (d is None, d or 0, i)
    for d, b in texts:
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(first.get(s, place(d, i)), place(d, i))
    out = []
    for d, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < place(d, i):
                gone[i : i + length] = True
        runs = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])[: len(b)]).sum()) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[: len(b)]])
        out.append((d if d is not None else -1, len(b), len(b) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def removal(docs):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs).collect())


def repeats(seed):
    rng, rows = random.Random(seed), []
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(90, 300))) for _ in range(6)]
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(0, 6)):
            parts.append(rng.choice(passages)[rng.randrange(0, 40) :] if rng.random() < 0.6 else "".join(rng.choice("xyz ") for _ in range(rng.randrange(0, 120))))
        rows.append((rng.randrange(80), "".join(parts)))
    return rows


def test_removal_equals_brute_force(spark, odd, none):
    short = [(r["doc_id"], r["text"][:3000] if r["text"] else r["text"]) for r in odd.collect()]
    periodic = [(1, "ab" * 300), (2, "b" + "ab" * 200), (3, "a" * 99), (4, "a" * 100), (5, "a" * 101), (6, "abc" * 100), (7, "\x00" * 250), (8, "é" * 130)]
    for rows in (repeats(1), repeats(2), periodic, short):
        assert removal(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)) == brute_removal(rows)
    assert removal(none) == []


def test_crowded_anchors_and_long_texts(spark, monkeypatch):
    rows = repeats(3)
    monkeypatch.setattr(suffix_dedup, "CROWD", 2)
    assert removal(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)) == brute_removal(rows)


def test_texts_read_in_parts_have_all_strings(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 256)
    rng = np.random.default_rng(6)
    data = rng.integers(97, 100, 3000).astype(np.uint8)
    offsets = np.array([0, 50, 1800, 1800, 3000])
    starts = sorted((int(t), int(s)) for text, _, low, high in suffix_dedup.anchors(data, offsets) for t, a, b in zip(text, low, high, strict=True) for s in range(a, b + 1))
    assert starts == [(i, s) for i in range(4) for s in range(int(offsets[i + 1] - offsets[i]) - 99)]


def test_previous_factor():
    rng = np.random.default_rng(7)
    values = rng.integers(0, 30, 200)
    want = [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(200)]
    assert list(suffix_dedup.previous_smaller(values)) == want
    windows = rng.integers(0, 2, (300, 1)).astype(np.uint8).repeat(100, axis=1)
    windows[:, 50:] = rng.integers(0, 3, (300, 1))
    position = rng.integers(0, 200, 300)
    got = suffix_dedup.repeated_before(windows, position)
    assert list(got) == [any((windows[i] == windows[j]).all() and position[j] < position[i] for j in range(300)) for i in range(300)]


def test_kept_text_is_given_on_request(spark):
    docs = spark.createDataFrame([(1, "q" * 150), (2, "head " + "q" * 120 + " tail")], "doc_id bigint, text string")
    rows = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.remove_repeats(docs, with_text=True).collect()}
    assert rows == {1: b"q" * 100, 2: b"head  tail"} or rows[2] == b"head  tail"


def test_bitmap_of_arrow_sets():
    sets = jaccard_join.shingle_sets(pa.array(["A b c d E f", "a B c d e f", None, " ", "a b"]))
    assert [len(s) for s in sets] == [2, 2, 0, 0, 1] and (sets[0] == sets[1]).all()
