import random

import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns of clashing names."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    base = [word() for _ in range(60)]
    long = " ".join(word() for _ in range(20_000))
    rows = [
        (1, " ".join(base), "en", "s1"),
        (2, " ".join(base), "en", "s1"),
        (3, " ".join([*base[:-1], "other"]), None, None),
        (4, "", "en", "s2"),
        (5, None, "de", "s2"),
        (6, " \t\n\x0b ", "de", "s2"),
        (7, "a b c", "en", "s1"),
        (8, "A\tb  C", "en", "s1"),
        (None, " ".join(base), "en", "s1"),
        (9, long, "fr", "s3"),
        (10, "1234 !!! ???", "fr", "s3"),
        (10, "1234 !!! ???", "fr", "s3"),
        (11, "über die Straße <|endoftext|> 中文 \U0001f600 İstanbul", "de", "s3"),
        (12, long + " end", "fr", "s3"),
    ]
    schema = "doc_id long, text string, lang string, source string, id long, ids string, tokens int, node long, k0 string, bucket int, block int, row int, word string, train boolean"
    return spark.createDataFrame([(*r, 1, "x", 2, 3, "y", 4, 5, 6, "z", None) for r in rows], schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
