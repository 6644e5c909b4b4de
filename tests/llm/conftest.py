import pytest

LONG = "of the word and more " * 6000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with names the
    operators use inside."""
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (2, None, None), (None, "no id here at all", "y"),
            (None, None, None), (3, "", "x"), (4, LONG, "z"), (5, "a b c d e f g", "x"), (6, "Ünïcode 𝔘 K straße\n\n  x", "x"),
            (7, "   \n\t ", None), (8, "word", "x")]
    return spark.createDataFrame([(i, t, s, "k", 0, 1.0, "w") for i, t, s in rows],
                                 "doc_id long, text string, source string, key string, fp int, score double, w string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


def plain(df):
    """Rows as dictionaries, ordered by their content."""
    return sorted((r.asDict() for r in df.collect()), key=lambda d: repr(sorted(d.items())))
