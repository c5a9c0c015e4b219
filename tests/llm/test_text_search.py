import random
import re

import pyarrow as pa
import pytest

from palisade.llm import decontamination, personal_data, quotation
from palisade.operators import ordering

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m.group())) <= 19 and personal_data.luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]


def test_patterns_equal_the_plain_ones():
    rng = random.Random(8)
    for _ in range(20000):
        text = "".join(rng.choice("aZ1@@..-%_ +2é()55") for _ in range(rng.randrange(40)))
        assert personal_data.base_spans(text) == plain_base(text)
    cards = "4111111111111111 4111-1111-1111-1111 4111111111111112 4111 1111 1111 1111 0"
    assert personal_data.base_spans(cards) == plain_base(cards)


def test_long_runs_are_read_once():
    for text in ("a" * 300000, "1" * 300000, "1.1." * 50000, "a@" * 50000, "+1" * 50000):
        personal_data.base_spans(text)


@pytest.fixture(scope="module")
def field():
    return personal_data.train(personal_data.parse_labelled(personal_data.LABELLED))


def test_field_learns_its_table_and_more(field):
    rows = personal_data.parse_labelled(personal_data.LABELLED)
    right = sum(got == [(personal_data.ADDED[k], a, b) for k, a, b in spans] for (_, spans), got in zip(rows, personal_data.field_spans([t for t, _ in rows], field), strict=True))
    assert right >= 0.9 * len(rows)
    for text, part in [("please dial (503) 555-0148 quickly", "(503) 555-0148"), ("she has 212-555-0187 at home", "212-555-0187")]:
        (_, added), = personal_data.find([text], field)
        assert [text[a:b] for _, a, b in added] == [part]


#: made up, none of it in the table that the field learns
HELD_OUT = """
please call {phone|(617) 555-0123} before noon
her phone is {phone|718-555-0166} now
tel {phone|0161 496 0753} at the desk
mobile {phone|07700 900456} , office {phone|(089) 636480-10}
ring {phone|1-888-555-0142} or {phone|404.555.0135} tonight
fax {phone|646-555-0177} please
call {phone|(305) 555-0190} for a table
write to {mail|mary dot smith at example dot com} today
mail {mail|tom (at) example (dot) org} please
contact {mail|sales [at] example [dot] com} for prices
reach {mail|lee9 at mail dot example dot net} now
email {mail|office at example dot org} by noon
ssn {number|219-45-6789} was given
passport {number|X12Y34567} expired
iban {number|FR76 3000 6000 0112 3456 7890 189} for fees
iban {number|NL91 ABNA 0417 1643 00} is ours
the year 2019 was short and 2003 too
on 2023-11-12 at 08:45 we left
version 3.2.1 came after 3.2.0
it cost 4,500.00 or 12 in all
pages 30-45 and 210-219 of 400
they lost 2-5 and then 14-21
room 118 , floor 7
order 300-400 units at 20 each
at 17:20 on 01/02/2021
a dot on the chart at 12.5 by 44.1
she was at work at 9 and at home at 6
line 7654321 of 9999999
THE## 6011000990139437## OF##
in 1871-72 and 1939-45
""".strip().splitlines()


def test_field_on_a_held_out_table(field):
    """Precision and recall of each kind over rows that it has not learnt."""
    from collections import Counter

    rows = personal_data.parse_labelled(HELD_OUT)
    right, given, wanted = Counter(), Counter(), Counter()
    for (_, spans), got in zip(rows, personal_data.field_spans([t for t, _ in rows], field), strict=True):
        want = {(personal_data.ADDED[k], a, b) for k, a, b in spans}
        for kind, a, b in got:
            given[kind] += 1
            right[kind] += (kind, a, b) in want
        wanted.update(k for k, _, _ in want)
    figures = {k: (right[k] / max(given[k], 1), right[k] / wanted[k]) for k in wanted}
    print(figures)
    assert set(figures) == set(personal_data.ADDED.values()) and all(p >= 0.9 and r >= 0.9 for p, r in figures.values()), figures


def test_viterbi_finds_the_best_path(field):
    import itertools

    import numpy as np

    sentences = [personal_data.token_features(personal_data.tokens(t)) for t in ("call (555) 1", "at 12", "x")]
    emit, lengths = field.scores(sentences)
    for k, path in enumerate(field.decode(sentences)):
        n = lengths[k]
        if n > 4:
            continue
        value = lambda p: emit[k, 0, p[0]] + field.move[-1, p[0]] + sum(field.move[p[t - 1], p[t]] + emit[k, t, p[t]] for t in range(1, n))  # noqa: B023, E731
        best = max(value(p) for p in itertools.product(range(len(personal_data.LABELS)), repeat=int(n)))
        assert np.isclose(value(list(path)), best)


def test_clean_text_stays_clean(small, field):
    texts = [r["text"] for r in small.collect() if not re.search("[0-9@]", r["text"])]
    assert texts and all(not base and not added for base, added in personal_data.find(texts, field))


def test_personal_data_of_odd_rows(odd, none):
    rows = personal_data.find_personal_data(odd).collect()
    assert len(rows) == odd.count() and all(r["spans"] == "" or r["spans"].count(":") % 2 == 0 for r in rows)
    assert personal_data.find_personal_data(none).collect() == []


ITEMS = [
    (1, "Anna has 12 apples and gives 5 km of rope to Peter. How many apples are left for Anna when Peter gives back 3 apples?"),
    (2, "The same plain words stand here without any number or name, and they go on for a while longer."),
    (3, "too short"),
    (4, None),
]


def test_templates():
    _, template, plain, _ = decontamination.templates(pa.array(["we saw Anna walk 12 km to Älva. Then home", "We saw bert walk 7 miles to älva. Then home"]))
    assert list(plain) == [True, True, False, True, False, False, True, False, True, True, True, True, True, True, False, False, True, True, True, True]
    assert (template[[0, 1, 3, 4, 5, 6]] == template[[10, 11, 13, 14, 15, 16]]).all()


def leaks(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"], r["exact"]) for r in decontamination.find_leaks(docs, items).collect()}


def test_leaks(spark):
    asked = ITEMS[0][1]
    texts = [
        f"before {asked} after",
        asked.upper().replace("?", ""),
        "Well, " + asked.replace("12", "31").replace("5 km", "9 miles").replace("Anna", "Berta").replace("Peter", "Josef").replace(" 3 ", " 8 "),
        asked.replace("to Peter", "to Josef").replace("when Peter", "when Maria").replace("for Anna", "for Karl").replace("12", "7"),
        "nothing of the kind is written here, only words that go on and on and on",
        f"{ITEMS[1][1].replace(',', ' ,')}",
        None,
        "",
    ]
    assert leaks(spark, texts) >= {(0, 1, True), (2, 1, False), (5, 2, True)}
    assert {d for d, _, _ in leaks(spark, texts)} <= {0, 1, 2, 5}


def test_texts_of_one_id_are_aligned_apart(spark):
    """Two texts that hold half of an item each are no leak, whatever their ids."""
    words = "the farmer walks along the river with seven old friends while singing songs about winter and counting every boat that passes under the wooden bridge".split()
    item, half = " ".join(words), len(words) // 2
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    parts = [" ".join(words[: half - 1]) + " stops here for lunch", "after lunch " + " ".join(words[half + 1 :])]
    for ids in ((None, None), (5, 5), (1, 2)):
        docs = spark.createDataFrame(list(zip(ids, parts)), "doc_id bigint, text string")
        assert decontamination.find_leaks(docs, items).collect() == []
    docs = spark.createDataFrame([(None, parts[0]), (None, f"well {item}"), (7, f"well {item}"), (7, f"well {item}"), (7, parts[1]), (None, None)], "doc_id bigint, text string")
    found = decontamination.find_leaks(docs, items).collect()
    assert sorted(((r["doc_id"], r["matched"] == r["n_windows"], r["exact"]) for r in found), key=str) == [(7, True, True), (None, True, True)]


def test_leaks_of_odd_tables(spark, odd, none):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert decontamination.find_leaks(none, items).collect() == [] and decontamination.find_leaks(odd, items.limit(0)).collect() == []
    left = decontamination.without_leaks(odd, items.union(spark.createDataFrame([(9, "the lazy dog and runs far away into the deep green woods today")], items.schema)))
    assert left.columns == odd.columns and left.count() == odd.count() - 2


def test_verbatim_items_in_documents(spark, data, small):
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    norm = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    known = [(r["item_id"], norm(r["text"])) for r in items.collect()]
    want = {(r["doc_id"], i) for r in small.collect() for t in [norm(r["text"])] for i, item in known if item in t}
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.find_leaks(small, items).collect()} == want and want


def leaks_of(spark, items, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    asked = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]): r["exact"] for r in decontamination.find_leaks(docs, asked).collect()}


def test_short_items_and_items_of_numbers(spark):
    items = ["What is the capital city of France?", "1 4 9 16 25 36 49 64 81 100 121 144", "Name Paris", "12 in all?"]
    texts = [
        "The quiz went on for hours. What is the capital city of France? Nobody in the room knew it.",
        "They asked what is the capital city of Norway and went home early that day.",
        "squares are 0 1 4 9 16 25 36 49 64 81 100 121 144 and so on",
        "squares are 0 1 4 9 17 25 36 48 64 81 101 121 144 and so on",
        "so please name Paris, and count 12 in all, not more than that",
        "so please name London, and count 13 in all, not more than that",
    ]
    assert leaks_of(spark, items, texts) == {(0, 0): True, (1, 0): False, (2, 1): True, (4, 2): True, (4, 3): True}


def test_words_put_in_or_left_out(spark):
    words = "this is one long plain question about some very old houses which stand in green hills today".split()
    middle = len(words) // 2
    items = [" ".join(words), "we sent Peter 5 km down the road with 1250 grams of bread and asked him for more of it"]
    texts = [
        f"so here {' '.join([*words[:middle], 'extra', *words[middle:]])} ends",
        f"so here {' '.join([*words[:middle], *words[middle + 1 :]])} ends",
        "we sent Peter Paul 5km down the road with 1 250 grams of bread and asked him for more of it",
        "some very old houses stand here, and in green hills this is one plain question",
        f"{' '.join(words[:8])} then something else altogether comes in between here {' '.join(words[12:])}",
    ]
    assert set(leaks_of(spark, items, texts)) == {(0, 0), (1, 0), (2, 1)}


def test_runs_of_placeholders_are_one():
    one = lambda t: decontamination.templates(pa.array([t]))
    for a, b, same in [("it costs 1250 now", "it costs 1 250 now", True), ("go 5km on", "go 5 km on", True), ("we saw Peter there", "we saw Peter Paul there", False), ("take 12 5 of", "take 1 25 of", False)]:
        (_, x, p, v), (_, y, q, w) = one(a), one(b)
        assert list(x) == list(y) and list(p) == list(q) and (list(v) == list(w)) == same
    assert len(one("we saw Peter, Paul there")[1]) == 5


def test_names_that_begin_sentences_and_spelt_out_numbers(spark):
    asked = "Tom buys 12 pens at the shop. Mary takes 4 of them. Tom then gives half to his friend."
    counted = "we took three red boats and seven green ones over the lake before it was dark"
    texts = [
        asked.replace("Tom", "Karl").replace("Mary", "Eva").replace("12", "30"),
        asked.replace("12", "twelve").replace("4", "forty-two"),
        "Well, " + asked.replace("Tom", "Otto"),
        counted.replace("three", "14").replace("seven", "twenty one"),
        asked.replace("Tom then", "Josef then").replace("Mary", "Tom"),
        "Dr. Otto bought it for Dr. Berta and in room 4 Karl sold it again to her",
    ]
    titled = "Dr. Tom bought it for Dr. Mary and in room 7 Sue sold it again to her"
    assert set(leaks_of(spark, [asked, counted, titled], texts)) == {(0, 0), (1, 0), (2, 0), (3, 1), (5, 2)}
    assert not any(leaks_of(spark, [asked], texts[:2]).values())


CHAT = [
    (1, 0, "user", "Hello there my friend.\nHow are you doing today?"),
    (1, 1, "assistant", "> How are you doing today?\n\nI am fine, thank you so much."),
    (1, 2, "user", "New topic now please, ok?"),
    (1, 3, "user", "On Monday X wrote:\n>> How are you doing today?\n> I am fine, thank\n> you so much.\nGlad to hear that."),
    (2, 0, "user", "> new  TOPIC now\n> please, ok?\nWhat do you mean by it?"),
    (2, 1, "user", "> nobody ever wrote this sentence\nyes"),
    (None, None, None, None),
    (3, 0, "user", ""),
    (3, 0, "user", ""),
    (4, 0, "user", "> " * 2000 + "deep"),
]
CHAT_SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_parse():
    content, n, deepest, quotes, own = quotation.parse("I say this now\n>> two levels deep here\n> one level only here\nbye bye now then")
    assert content == "I say this now\nbye bye now then" and n == 2 and deepest == 2 and {q[2] for q in quotes} == {1, 2} and len(own) == 3


def test_quotation_links(spark):
    rows = quotation.link_quotations(spark.createDataFrame(CHAT, CHAT_SCHEMA).repartition(3)).collect()
    by = {(r["conv_id"], r["turn"]): r for r in rows}
    assert len(rows) == len(CHAT)
    assert [(by[k]["parent_conv"], by[k]["parent_turn"], by[k]["depth"]) for k in [(1, 1), (1, 3), (2, 0), (2, 1)]] == [(1, 0, 1), (1, 1, 2), (1, 2, 1), (None, None, 0)]
    assert by[(1, 3)]["content"] == "Glad to hear that." and by[(1, 3)]["n_linked"] == 2
    order = [(r["conv_id"], r["turn"]) for r in sorted((r for r in rows if r["thread_id"] == 1), key=lambda r: r["position"])]
    assert order == [(1, 0), (1, 1), (1, 3), (1, 2), (2, 0)]


def test_long_conversation_is_numbered_in_parts(spark):
    rows = [(7, i, "user", f"> line number {i - 1} of all\nline number {i} of all" if i else "line number 0 of all") for i in range(300)] + [(8, i, "user", f"other text {i}") for i in range(200)]
    got = quotation.link_quotations(spark.createDataFrame(rows, CHAT_SCHEMA)).collect()
    assert sorted((r["turn"], r["position"], r["depth"]) for r in got if r["conv_id"] == 7) == [(i, i, i) for i in range(300)]
    assert sorted((r["turn"], r["position"], r["depth"]) for r in got if r["conv_id"] == 8) == [(i, i, 0) for i in range(200)]
    assert quotation.link_quotations(spark.createDataFrame([], CHAT_SCHEMA)).collect() == []


def test_quoted_sentences_paragraphs_and_unspaced_texts(spark):
    rows = [
        (1, 0, "user", "The first part is short. The second one says much more! A third ends it."),
        (1, 1, "user", "> The second one says much more!\nyes"),
        (2, 0, "user", "One paragraph of five words.\n\nAnother paragraph\nfollows it here.\n\nA last one stays out."),
        (2, 1, "user", "> One paragraph\n> of five words.\n>\n> Another paragraph follows\n> it here.\nno"),
        (3, 0, "user", "今天天气非常好。我们一起去公园散步吧！"),
        (3, 1, "user", "> 我们一起去公\n> 园散步吧！\n好"),
        (3, 2, "user", "> 今天\n不"),
        (4, 0, "user", "สวัสดีตอนเช้าวันนี้อากาศดีมาก"),
        (4, 1, "user", "> สวัสดีตอนเช้าวันนี้อากาศดีมาก\nค่ะ"),
    ]
    got = {(r["conv_id"], r["turn"]): (r["parent_conv"], r["parent_turn"]) for r in quotation.link_quotations(spark.createDataFrame(rows, CHAT_SCHEMA)).collect()}
    linked = {(1, 1), (2, 1), (3, 1), (4, 1)}
    assert got == {k: (k[0], 0) if k in linked else (None, None) for k in got}


def test_a_message_that_many_quote_is_numbered_in_parts(spark, monkeypatch):
    written = []
    through = ordering.write_through
    monkeypatch.setattr(ordering, "write_through", lambda df, label: written.append(through(df, label)) or written[-1])
    rows = [(0, 0, "user", "Hello to all of you")] + [(i, 0, "user", f"> Hello to all of you\nanswer {i}") for i in range(1, 2001)] + [(None, i % 50, "user", f"text {i}") for i in range(1000)]
    merged = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(merged)
    spark.conf.set(merged, "false")
    try:
        got = quotation.link_quotations(spark.createDataFrame(rows, CHAT_SCHEMA)).collect()
    finally:
        spark.conf.set(merged, before)
    for thread, n in ((0, 2001), (None, 1000)):
        assert sorted(r["position"] for r in got if r["thread_id"] == thread) == list(range(n))
    assert [r["conv_id"] for r in sorted((r for r in got if r["thread_id"] == 0), key=lambda r: r["position"])] == list(range(2001))
    sizes = [r["count"] for r in written[0].groupBy("thread_id", "_part").count().collect()]
    assert max(sizes) < 1500 and sum(sizes) == 3001
