import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text, lang, source) tuples, with extra columns that operators also use as names."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                           T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("fp", T.StringType()),
                           T.StructField("key", T.LongType()), T.StructField("range", T.LongType()), T.StructField("score", T.StringType()),
                           T.StructField("_row_hash", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("topic", T.LongType())])

    def make(rows):
        full = [(*r, *([None, "en", "s"][len(r) - 1:] if len(r) < 4 else [])) for r in rows]
        return spark.createDataFrame([(a, b, c, d, None if b is None else len(b), "x", 1, 2, "y", "z", "k", 3) for a, b, c, d in full], schema)

    return make


ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "a null key with some words in it"), (None, None), (4, "one"), (4, "one"), (5, "one"),
       (6, "word " * 30000), (7, "The cat sat on the mat and it was happy there, as the dog was out of the house for the day. " * 3)]


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls, blanks, repeated rows, ties, a very long text."""
    return docs_of(ODD)
