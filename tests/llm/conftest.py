import pytest

from tablework.llm import common

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, fp long, label string, size int"


@pytest.fixture(scope="session", autouse=True)
def prepared(spark):
    common.ready(spark)


@pytest.fixture
def frame(spark):
    """Documents of (id, text) with columns named like those that operators make for themselves."""

    def make(rows, lang=None):
        full = [(i, t, lang, None, None, 7, 7, "x", 1) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


def odd_rows():
    """Null ids and texts, empty and blank texts, repeated rows and ids, one very long text."""
    long_text = " ".join(f"word{i % 977} number{i % 31}" for i in range(60_000))
    return [
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (None, "a b c"),
        (None, None),
        (4, "Same text here now again"),
        (4, "Same text here now again"),
        (5, "same  text here now again"),
        (6, long_text),
        (6, "other text of a repeated id"),
        (7, "Äpfel 中文 \U0001f600 İ ó"),
    ]
