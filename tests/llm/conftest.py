import random

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    r = random.Random(5)
    long = " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randint(0, 50)) for _ in range(30_000))
    data = [
        (1, None, "en", "s1", 0), (2, "", None, None, 0), (3, "a b", "en", "s1", 3), (3, "a b", "en", "s1", 3), (None, "a b", "en", None, None),
        (4, long, "en", "s2", len(long)), (5, " \n\t ", "en", "s2", 4), (6, "é ü <|endoftext|> İ Ж 日本", "en", "s2", 9), (None, None, None, None, None),
    ]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    names = "row block owner hash path bucket score n_words held_out found part n shingles component set_key id label draw copies".split()
    return df.select("*", *[F.lit("clash").alias(n) for n in names])


@pytest.fixture(scope="session")
def empty(odd):
    return odd.filter("false")
