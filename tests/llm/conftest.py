import pytest


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text, source, lang); columns that clash with names used inside."""
    kinds = "doc_id bigint, text string, source string, lang string, n_chars bigint, count bigint, rank bigint, part bigint"

    def make(rows):
        full = [(d, t, s, g, None if t is None else len(t), 1, 2, 3) for d, t, s, g in rows]
        return spark.createDataFrame(full, kinds)

    return make


ODD = [
    (1, None, "a", "en"), (2, "", "a", None), (3, " \t\n\r\x0b\x0c ", None, "en"), (4, "one two three", None, "en"),
    (5, "one two three", "b", "en"), (5, "one two three", "b", "en"), (None, "four words are here", "b", "fr"),
    (6, "long " * 30_000, "a", "en"), (7, "ÉTÉ é x y 漢字 🙂 <|endoftext|> a  b", "c", "de"), (8, "12 34 !!", "", "es"),
    (9, "the quick brown fox jumps over the lazy dog and runs home", "a", "en"),
    (10, "The quick  brown fox jumps over the lazy dog\nand runs home", "a", "en"),
]


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Null, empty, wordless, very long, repeated, tied and unusual rows."""
    return make_docs(ODD)


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
