import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, slot string, taken string, passes string, failures string, measures string, fp string, spans string, score string, id string, words string, k1 string"
CLASHES = ["x"] * 12


def prose(seed, n):
    """Invented words, hardly ever the same twice in a row."""
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture
def prose_of():
    return prose


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in any column, empty and blank and very long texts, repeated rows and ids, ties, clashing columns."""
    long = prose(1, 30_000)
    same = prose(2, 120)
    rows = [
        (None, None, None, None, None), (1, "", "en", "a", 0), (2, "  \n\t ", "en", "a", 4), (3, None, None, "a", None), (4, same, "en", "b", 9),
        (4, same, "en", "b", 9), (5, same, None, None, 9), (6, long, "fr", "b", 9), (7, prose(3, 80) + " é😀 �", "fr", "a", 9), (None, prose(4, 60), "en", "c", 1),
        (8, "one", "en", "c", 3), (8, "another text of the same id", "en", "c", 3), (9, "aaaa " * 500, "en", "c", 3), (10, "a" * 5000, "de", "c", 3),
    ]
    return spark.createDataFrame([(*r, *CLASHES, "x") for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
