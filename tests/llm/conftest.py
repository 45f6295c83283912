"""Documents that every corpus operator must handle: nulls in any column, empty and very long
texts, ties, repeated rows, and extra columns whose names clash with those that operators use inside."""

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, shard string, at string, words string, rid int, fp int, h int, top int, n int, spans int, cand int"

LONG = "the river of words runs on and on without any end " * 20_000


def messy_rows():
    texts = [
        (1, "the cat sat on the mat and looked at the small dog over there", "en", "a"),
        (2, "the cat sat on the mat and looked at the small dog over there", "en", "a"),
        (3, "", "en", "b"),
        (4, None, None, None),
        (None, "der hund und die katze sind in dem garten und spielen mit dem ball", "de", "b"),
        (5, None, "de", None),
        (6, LONG, "en", "a"),
        (6, LONG, "en", "a"),
        (7, "der hund und die katze sind in dem garten und spielen mit dem ball heute", "de", "c"),
        (8, "12345 !!! ???", None, "c"),
        (9, "mail me: jo.doe@example.com or +1 (212) 555-0199, ip 10.0.0.1 😀 4111 1111 1111 1111", "en", "c"),
        (9, "another text with the same id", "en", "b"),
        (None, None, None, "a"),
        (10, "x", "en", "a"),
    ]
    return [(i, t, la, s, None if t is None else len(t), *([k % 3] + ["z"] * 3 + [k] * 7)) for k, (i, t, la, s) in enumerate(texts)]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
