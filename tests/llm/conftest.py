"""Documents with the cases every operator has to take."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kind string"
WORDS = "the quick brown fox jumps over the lazy dog while seven small birds sing about rain and warm summer evenings".split()


def sentence(seed: int, size: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * (seed % 5 + 1)) % len(WORDS)] for i in range(size))


ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "One  two\tthree"), (5, "One two three"), (6, "one two three"),
    (None, "One two three"), (7, "ÄÖÜ élan   日本語 😀"), (8, "x" * 20_000), (9, sentence(3, 9_000)), (9, sentence(3, 9_000)),
    (10, "!!! 123 ..."), (11, "a"), (-3, "One two three"), (12, "<|endoftext|> it's 42"), (12, "other text of the same id"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty texts, a very long one, repeated rows and ids, clashing columns."""
    rows = [(i, t, None if i == 4 else "en", None, None, 0.5, "kind") for i, t in ODD]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(i, 0, i % 2) for i in range(1, 13)] + [(None, 0, 1), (5, None, None), (4, 1, 1), (4, 1, 1)],
        "doc_id long, quality int, toxic int",
    )
