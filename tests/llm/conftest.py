import pytest

HARD = [
    (1, "", "a"), (2, None, "a"), (3, "one", None), (3, "one", None), (None, "no id at all", "b"), (None, None, None),
    (4, "the same words again and again and again and again and again and again", "b"), (5, "x" * 300_000, "b"), (6, "word " * 60_000, "c"),
    (7, "mail a.b@c.de and 10.0.0.1, card 4111 1111 1111 1111, call +1 (415) 555-2671 now\n\n", "a"), (8, "Größe <|im_end|> <|endoftext|> é \x0b\x0cz ", "a"),
    (9, " \t\n ", "c"), (10, "idiot! You are an idiot.\nFine day.", "a"), (11, "idiot! You are an idiot.\nFine day.", "a"), (12, "trailing  double  blanks ", "b"),
]


@pytest.fixture(scope="session")
def hard(spark):
    """Nulls, empty and very long texts, repeated rows, and extra columns with names that operators use."""
    rows = [(i, t, s, 1, "k", 2.0, 3) for i, t, s in HARD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, key string, __id double, count int")


@pytest.fixture(scope="session")
def empty(spark, hard):
    return spark.createDataFrame([], hard.schema)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
