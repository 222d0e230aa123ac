import pytest

FOLDER = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _fp string, row string, ids string, rate string, _text string"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with names that operators use themselves."""
    long = " ".join(f"wörd{i} and the" for i in range(30_000))
    texts = [
        (1, "One text of five words."), (2, "One  text\nof five words."), (2, "One  text\nof five words."), (3, None), (4, ""), (5, " \t "),
        (6, long), (7, long), (None, "no id"), (None, None), (8, "x" * 70_000), (9, "1234"), (10, "<|endoftext|> ▁ \U0010ffff á"), (None, "no id"),
    ]
    rows = [(i, t, "en" if i else None, "s" if i and i % 2 else None, 1, "a", "b", "c", "d", "e") for i, t in texts]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
