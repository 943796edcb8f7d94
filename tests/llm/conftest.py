"""Documents with every odd case the operators must take."""

import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "sta", "tri", "vel") for b in ("n", "r", "sto", "dam", "ling", "q", "té")]


def prose(rng, count):
    return " ".join(rng.choice(WORDS) for _ in range(count))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, blanks, repeated rows, one id with two texts, long text and long words."""
    rng = random.Random(5)
    shared = prose(rng, 70)
    rows = [(i, prose(rng, rng.randint(1, 120))) for i in range(100, 140)]
    rows += [(1, None), (2, ""), (3, " \t\n "), (None, prose(rng, 30)), (None, None)]
    rows += [(4, "Same row twice here"), (4, "Same row twice here"), (5, "first text"), (5, "second text of one id")]
    rows += [(6, f"{prose(rng, 9)} {shared} {prose(rng, 12)}"), (7, f"{prose(rng, 25)}\n{shared.upper()} {prose(rng, 3)}")]
    rows += [(8, prose(rng, 30_000)), (9, "x" * 50_000), (10, "a@b " * 200 + "é\U0001f600 tail"), (11, shared), (12, shared)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows as a table whose other columns bear names that the operators use inside."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(odd_rows, "doc_id long, text string")
    for name in ("key", "fp", "fold", "label", "x", "y", "node", "rank", "levels", "spans", "hash", "length", "score", "root", "id"):
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    return docs


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")
