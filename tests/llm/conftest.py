import os

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Rows -> documents with columns that clash with names the operators use inside."""

    def make(rows):
        full = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]
        df = spark.createDataFrame(full, DOCS)
        for c in ("id", "fp", "size", "h", "sha", "item", "w", "y", "score", "n", "start", "body", "digest", "u", "v"):
            df = df.withColumn(c, F.lit(f"clash-{c}"))
        return df

    return make


#: null, empty, blank, long, repeated and tied rows of documents
ODD = [(1, None, None, None), (2, "", "en", "b"), (3, " \t\n", "en", "b"), (4, "a word or two", "en", "a"), (4, "a word or two", "en", "a"), (5, "a word  or two", "en", None), (None, "no id here", "fr", "a"), (6, "long " * 60_000, "en", "c"), (7, "été à la plage 🙂", "fr", "c")]


@pytest.fixture
def odd():
    return ODD


@pytest.fixture(scope="session")
def small():
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    return d
