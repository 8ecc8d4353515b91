"""Corpus lines for the tests."""

from wordfold.sources.text import read_corpus


def lines_df(spark, texts):
    """Corpus lines from literal texts (one document per text)."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return read_corpus(df)
