import random

import pytest

ODD_COLUMNS = "id long, key string, size string, component string, component_id long, n_words long, spans string, __x int"


@pytest.fixture(scope="session")
def prose():
    """prose(n, seed): n words of made-up text."""

    def make(n: int, seed: int) -> str:
        r = random.Random(seed)
        return " ".join("".join(r.choice("abdeilnorstu") for _ in range(r.randint(2, 8))) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd(spark, prose):
    """Documents with nulls in any column, empty, blank and very long texts, repeated rows and clashing extra columns."""
    long = prose(30_000, 1)
    rows = [
        (None, "no id " + prose(60, 2), "en", "a", 5), (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n\x0b ", "en", "a", 3), (4, long, "en", None, 9),
        (5, prose(80, 3), "en", "b", 9), (5, prose(80, 3), "en", "b", 9), (6, prose(80, 3), None, "b", 9), (7, "one two", "en", "c", 7), (8, "One two", "en", "c", 7), (9, "é€😀 ▁x", "fr", "c", 7),
    ]
    extra = (1, "k", "s", "c", 2, 3, "x", 4)
    return spark.createDataFrame([r + extra for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {ODD_COLUMNS}")


@pytest.fixture(scope="session")
def none(odd):
    """The same table without rows."""
    return odd.where("false")
