"""Filter audit, alignment of tokenizers and the piece codec beside plain versions."""

import hashlib
from bisect import bisect_left
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import check
from palisade.llm import filter_audit, piece_codec, token_alignment
from palisade.llm.queries import ORACLES

TEXTS = [
    "Plain words, a <s> token </s> and <|endoftext|> as text <0x0A>.", "  two  spaces\tand\n\nlines ", "▁ a mark ▁▁ in it", "naïve Ærøskøbing 你好世界 🙂🙂 ﷽ \x00\x1c\x85 nbsp x　y",
    "x" * 5000, "ab" * 3000 + " " * 700 + "12345678901234567890", "​﻿ ", "don't 'Twas !!! ''s 's", " ", "a", " \n", "word " * 3000, "é́ café", "\x1c a\x1d b \x1e\x1e c",
]


@pytest.fixture(scope="module")
def codec():
    with open(piece_codec.model_path(), "rb") as f:
        return piece_codec.PieceCodec(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_path())


@pytest.fixture(scope="module")
def documents(spark, odd, small):
    """Odd documents, awkward texts and the driver's, in one table."""
    extra = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string")
    return odd.select("doc_id", "text").union(small.select("doc_id", "text")).union(extra)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab e\n▁  th.12'é你"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_codec_equals_library(codec, library, text):
    ids = [int(i) for s in codec.segments(text) for i in codec[s][1].split(",")]
    assert ids == library.encode(text)
    assert "".join(codec[s][2] for s in codec.segments(text))[1:] == library.decode(ids)
    codec.check()
    assert not codec.odd


def test_codec_query(spark, documents, library):
    want = Counter()
    for r in documents.collect():
        ids = library.encode(r["text"] or "")
        want[r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)), True] += 1
    assert Counter(map(tuple, piece_codec.encode_documents(documents).collect())) == want


def test_ids_go_back_to_texts(spark, odd):
    back = piece_codec.decode_documents(piece_codec.encoded_ids(odd))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=repr)


def test_a_difference_from_the_library_shows(codec):
    codec.clear()
    codec.fresh = [("▁abc", [5])]
    codec["▁abc"] = (1, "5", " abc")
    codec.check()
    assert codec.odd == {"▁abc"}
    codec.odd.clear()
    codec.clear()


def brute_alignment(texts):
    """Every text by whole calls of the libraries, and groups by walking over the bytes."""
    a = Tokenizer.from_file(token_alignment.byte_model())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=token_alignment.piece_model())
    known = token_alignment.Aligner(a.to_str(), open(token_alignment.piece_model(), "rb").read())
    rows = []
    for text in texts:
        x, y = (a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_ = f" {text}".encode()
        if b"".join(known.bytes_a[i] for i in x) != bytes_ or b"".join(known.bytes_b[i] for i in y) != bytes_:
            x, y = [], []
        ends_x, ends_y = np.cumsum([len(known.bytes_a[i]) for i in x]).tolist(), np.cumsum([len(known.bytes_b[i]) for i in y]).tolist()
        cuts = sorted(set(ends_x) & set(ends_y))
        groups = [([], []) for _ in cuts]
        for side, (ids, ends) in enumerate(((x, ends_x), (y, ends_y))):
            for i, e in zip(ids, ends, strict=True):
                groups[bisect_left(cuts, e)][side].append(i)
        at_x, at_y = dict(zip(ends_x, x, strict=True)), dict(zip(ends_y, y, strict=True))
        rows.append((x, y, groups, [(at_x[c], at_y[c]) for c in cuts]))
    count = Counter(link for r in rows for link in r[3])
    most = {}
    for (_, j), n in count.items():
        most[j] = max(n, most.get(j, 0))
    for x, y, groups, links in rows:
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        yield len(x), len(y), len(groups), len(links), sum(count[k] == most[k[1]] for k in links), sum(count[k] for k in links), sha(text) if text else "", sum(len(p) * len(q) for p, q in groups)


def test_alignment_query(documents):
    rows = documents.collect()
    want = Counter((r["doc_id"], *x) for r, x in zip(rows, brute_alignment([r["text"] for r in rows]), strict=True))
    assert Counter(map(tuple, token_alignment.align_documents(documents).collect())) == want


def test_products_equal_dense_ones():
    rng = np.random.default_rng(5)
    for slice_ in (1, 7, 1 << 20):
        token_alignment.SLICE = slice_
        a, b = (rng.random((9, 14)) < 0.3 for _ in range(2))
        csr = lambda m: token_alignment.Csr(np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1], m.shape[1])
        dense = np.zeros((9, 9), int)
        for i, j, n in csr(a).product(csr(b).transposed()):
            dense[i, j] += n
        assert (dense == a.astype(int) @ b.astype(int).T).all()
    found = token_alignment.align(np.array([2, 3, 1, 4]), np.array([5, 2, 3]))
    assert [found.group_a.tolist(), found.group_b.tolist()] == [[0, 0, 1, 1], [0, 1, 1]]
    assert sorted(p for i, j in found.group_links() for p in zip(i.tolist(), j.tolist(), strict=True)) == [(0, 0), (1, 0), (2, 1), (2, 2), (3, 1), (3, 2)]
    assert [x.tolist() for x in token_alignment.overlap_links(np.array([2, 3]), np.array([1, 4]))] == [[0, 0, 1], [0, 1, 1], [1, 1, 3]]


def test_memory_of_parts_can_be_lost(documents):
    want = sorted(map(tuple, token_alignment.aligned_texts(documents).drop("links").collect()), key=repr)
    with open(token_alignment.byte_model(), encoding="utf-8") as f, open(token_alignment.piece_model(), "rb") as g:
        known = token_alignment.Aligner(f.read(), g.read())
    got = []
    for r in documents.collect():
        totals, groups, *_ = known.texts([r["text"]])
        got.append((r["doc_id"], *totals[0].tolist(), sha(groups[0]) if groups[0] else ""))
        known.forget()
    assert sorted(got, key=repr) == want


def test_empty_tables(none, spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for out in (piece_codec.encode_documents(none), token_alignment.align_documents(none), filter_audit.audit_filters(none, labels)):
        assert out.collect() == []


def test_ranks_are_those_of_all_orders():
    orders = ["".join(p) for p in permutations(filter_audit.FILTERS)]
    assert [filter_audit.rank(o) for o in orders] == list(range(120))
    seen = {(m, s, r) for m, s, low, high in filter_audit.intervals() for r in range(low, high)}
    want = set()
    for r, order in enumerate(orders):
        for mask in range(1, 32):
            want.add((mask, 1 + min(i for i, x in enumerate(order) if mask & filter_audit.bit(x)), r))
    assert seen == want


def test_audit_of_odd_rows_equals_sql(spark, tmp_path, odd):
    """Null and repeated ids, null texts and parts, labels given twice and to no document."""
    marks = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, None), (10, None, 1), (99, 1, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    odd.write.parquet(f"{tmp_path}/documents")
    marks.write.parquet(f"{tmp_path}/labels")
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}/*.parquet')")
    run = lambda s, _: filter_audit.audit_filters(odd, marks.withColumns({"n": marks.doc_id, "part": marks.doc_id}))
    problem, rows = check.compare(spark, con, None, "op11", run, ORACLES["op11_filter_audit"])
    assert problem is None and rows == 600 * odd.selectExpr("coalesce(lang, '')").distinct().count()
