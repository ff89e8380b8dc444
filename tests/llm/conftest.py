import random

import pytest

#: Rows that every document operator must stand: null and empty texts, no letters, repeats, very long words and texts.
ODD = [
    (1, "The cat sat on the mat and looked at the old house."), (2, "The cat sat on the mat and looked at the old house."), (3, None), (4, ""), (5, " \t\n "), (6, "1234 !!! 5678"),
    (7, "a"), (8, "x" * 20_000), (9, "word " * 5_000), (10, "Zażółć gęślą jaźń ▁ 漢字 🙂"), (10, "a second row of one id"), (None, "a row without an id"), (11, "<|endoftext|> is text here"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with columns whose names clash with what operators add."""
    rows = [(i, t, "en", "s", 0, 1.0, "z", [1], 2, 3) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, key string, drop array<int>, of long, n_lines long").repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark, base):
    return spark.read.parquet(f"{base}/documents.parquet")


@pytest.fixture
def rng():
    return random.Random(7)
