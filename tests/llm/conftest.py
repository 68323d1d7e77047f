"""Small frames for the operators: every awkward text there is, under clashing column names."""

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use inside
    T.StructField("row", T.StringType()), T.StructField("size", T.DoubleType()), T.StructField("fp", T.StringType()),
    T.StructField("bin", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("h", T.StringType()),
    T.StructField("id", T.StringType()), T.StructField("shard", T.StringType()), T.StructField("doc", T.StringType()),
])


def document(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), *["x"], 1.5, *["x"] * 7)


@pytest.fixture(scope="session")
def make(spark):
    """make([(doc_id, text, lang, source), ...]): a documents table with extra columns of clashing names."""
    return lambda rows: spark.createDataFrame([document(*r) for r in rows], SCHEMA)


WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they".split()


def prose(n, seed=1):
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ly", "ing"]) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(make):
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids."""
    long = prose(30_000, 5)
    return make([(1, None), (2, ""), (3, " \t\n\r "), (4, "one"), (5, prose(60)), (5, prose(60)), (6, prose(60)), (None, prose(40, 2)),
                 (None, None, None, None), (7, prose(80, 3), None, "b"), (8, long, "en", None), (9, long, "en", "b"), (10, "ünï çödé 漢字 " * 30),
                 (11, "$$$ ### " * 40), (12, prose(60), "fr", "c"), (13, "password = 'abcdef123456'", "de", "c"), (9, "another text", "en", "b")])


@pytest.fixture(scope="session")
def empty(make):
    return make([])
