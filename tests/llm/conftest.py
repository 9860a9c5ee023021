import pytest

from matstream.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return table(spark, SF, "documents")


#: nulls in every column, empty and long texts, ties, repeated rows, a clashing extra column
ODD = [
    (1, "", "en", "a", 0, "x"),
    (2, None, "en", "a", None, "x"),
    (3, "one two three", None, "b", 13, "x"),
    (3, "one two three", None, "b", 13, "x"),
    (4, "w " * 30000, "fr", None, 60000, "x"),
    (None, "one two three", "en", "b", 13, None),
    (5, "ONE two\tthree", "en", "b", 13, "x"),
    (6, "?!", "en", "c", 2, "x"),
    (7, "\x00  é日本 zero", "xx", "c", 10, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_key string"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
