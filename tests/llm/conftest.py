import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of texts (or of (doc_id, text) pairs)."""

    def make(rows, lang=None):
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        return spark.createDataFrame([(i, t, lang, None, None if t is None else len(t)) for i, t in pairs], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, white space, one letter, ties, repeated, special tokens, odd characters, very long."""
    return [None, "", " \n\t ", "a", "Same text here twice.", "Same text here twice.", "<|endoftext|> in <|startoftext|>text", "a  b \n\n c\x1cd e f", "it's we'll İstanbul ﬁn é \U0001f600\U0001f600!!", "### $$$ %%%", "word " * 30_000, "x" * 50_000]
