import pytest

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away into the deep green woods today.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog and runs far away into the deep green woods today.", "en", "a"),
    (3, None, "en", None),
    (4, "", None, "b"),
    (5, " \t\n\x0b\f\r ", "de", "b"),
    (6, "one two", "de", ""),
    (7, "12345 !!! ***", None, "b"),
    (8, "word " * 30000, "en", "a"),
    (9, "x" * 40000, "en", "c"),
    (None, "a text whose id is missing but which has more than five words", "en", None),
    (10, "ein kleiner Satz über Äpfel und Öl\nein kleiner Satz über Äpfel und Öl\n\nzum Schluß", "de", "b"),
    (10, "ein kleiner Satz über Äpfel und Öl\nein kleiner Satz über Äpfel und Öl\n\nzum Schluß", "de", "b"),
    (10, "the same id with another text altogether, so ids are not unique here", "en", "b"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, `set` string, size string, `row` int, `__key` string"


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents, with further columns whose names operators use themselves."""
    rows = [(i, t, lang, s, None if t is None else len(t), None, "x", "y", 0, "k") for i, t, lang, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
