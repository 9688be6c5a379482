"""Folders and fixtures of these tests; test modules import the fixtures they use."""

import pytest
from pyspark.sql import types as T

SF_DIR = "/root/testdata/sf0.001"
MORE_DIR = "/root/testdata/sf0.01"

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())])

#: Nulls, empty and blank texts, a very long one, ties, repeated rows.
ROWS = [
    (1, None, "a"),
    (2, "", None),
    (3, " \t\n ", "a"),
    (4, "One word, two words; one  word.\n\nTwo words ", "b"),
    (5, "the same line again and again here\n" * 12, "b"),
    (6, "the same line again and again here\n" * 12, "b"),
    (6, "the same line again and again here\n" * 12, "b"),
    (7, " ".join(f"w{i % 977} é{i % 31}" for i in range(20_000)), "c"),
    (8, "password = hunter22 and 0123456789abcdef01234567 x", None),
    (9, "Mixed CASE words, ſtrange İ letters\x0b中文字 and 😀 it's we'll 'S\r\n", "c"),
    (None, "a row without an id has a text, too", "d"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents of all odd kinds, with an extra column whose name may clash."""
    rows = [(*r, "x", i) for i, r in enumerate(ROWS)]
    schema = T.StructType([*DOCS.fields, T.StructField("n_tokens", T.StringType()), T.StructField("start", T.LongType())])
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def some_docs(duck):
    """doc_id, text of the small table."""
    return duck.execute("select doc_id, text from documents order by doc_id").fetchall()
