import pytest

#: Texts that every operator must take: null, empty, blank, very long, repeated, odd characters.
ODD_TEXTS = [None, "", "   \n\t ", "one two three", "One TWO three", "word " * 30_000, "é ñ 漢字 🎉 \x00 nul", "a\r\nb\r\n\nc\n", "same text of more than five words here", "same text of more than five words here"]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, ties, repeated rows and columns of names that operators use themselves."""
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, i, "x", 1, True) for i, t in enumerate(ODD_TEXTS)]
    rows += [(3, "one two three", "en", None, None, "y", None, None), (None, None, None, None, None, None, None, None), (None, "one two three", None, "s", 1, "z", 2, False)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, size int, kept boolean").withColumnRenamed("size", "token")


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")
