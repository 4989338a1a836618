import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, run int, key string, digest long, shard int, hash long, at long, bucket int"
ODD_TEXTS = [None, "", "  \n\t ", "one", "a b c d", "same text here for all of us", "same text here for all of us", "é <|endoftext|> x y ΑΣ"]


def documents(spark, texts, first=0):
    """A table with further columns whose names the operators use themselves, a repeated row and a null id."""
    rows = [(i + first, t, 1, "k", 2, 3, 4, 5, 6) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1], (None, "text of nobody", 1, "k", 2, 3, 4, 5, 6)] if rows else [], DOCS)


@pytest.fixture(scope="session")
def odd(spark):
    return documents(spark, [*ODD_TEXTS, "word " * 60_000])
