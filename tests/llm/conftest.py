import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, word string, fp string, mix_slot string"


def words(rng, n, letters="abcdeé"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def hard_rows():
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, clashing columns."""
    rng = random.Random(7)
    long = words(rng, 30_000)
    shared = words(rng, 40)
    rows = [(0, None, None, None), (1, "", "en", "a"), (2, "  \n\t", "en", None), (3, long, "de", "a"), (4, long, "de", "b"), (5, shared, "en", "a"), (6, "x " + shared + " y", "en", "a"), (7, "aaaa" * 200, None, "b"), (8, "12 34 ...", "en", "b"), (9, "\U0001d4d0 é 字", "fr", "b")]
    rows += [(5, shared, "en", "a"), (None, shared, "en", "a"), (-3, "short", "en", "c")]
    rows += [(i, words(rng, rng.randint(0, 60)), rng.choice(["en", "de"]), "a") for i in range(20, 60)]
    rows += [(i, rows[-1][1], "en", "a") for i in range(60, 70)]
    return [(i, t, lang, s, None if t is None else len(t), "k", "w", "f", "m") for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    return spark.createDataFrame(hard_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
