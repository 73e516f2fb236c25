import pytest

LONG = "alpha beta gamma delta " * 30000
ODD = [None, "", " \t\n ", "x", "one two", "one  two", LONG, "same words here again and again for all of us " * 8, "same words here again and again for all of us " * 8, "12345 !!! 67890", "é" * 300, "👍 日本 text"]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank, long, repeated and tied texts, repeated rows, null ids and columns with clashing names."""
    rows = [(i, t, "en" if i % 2 else "de", "s", 1, 7, 8, 9, "z") for i, t in enumerate(ODD)]
    rows += [rows[5], rows[6], (None, "text without an id", None, None, None, None, None, None, None)]
    names = "doc_id long, text string, lang string, source string, n_chars long, key long, rid long, n long, body string"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
