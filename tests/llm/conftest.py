import pytest

TEXTS = [
    "The quick brown fox jumps over the lazy dog near the river bank today",
    None,
    "",
    "   \n\t ",
    "one",
    "Ünïcode ＦＵＬＬ width ΣΑΣ straße   x",
    "word " * 6000,
    "a" * 5000,
    "The quick brown fox jumps over the lazy dog near the river bank today",
]


@pytest.fixture()
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and columns whose names clash."""
    rows = [(i, t, "en", "s", None) for i, t in enumerate(TEXTS)] + [(4, "one", "en", "s", 1), (4, "one", "en", "s", 1), (None, "no id at all here", None, None, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long").selectExpr("*", "1 as score", "2 as key", "3 as rep", "4 as n", "'x' as word", "'y' as html")


@pytest.fixture()
def no_docs(odd_docs):
    return odd_docs.limit(0)
