import random

import pytest
from pyspark.sql import types as T

WORDS = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "pi"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


#: documents with clashing extra columns (names the operators use inside or return)
EXTRA = ["score", "size", "shard", "slot", "words", "fp", "vals", "pos", "label", "copies", "kept", "start"]


def make_docs(spark, rows):
    """rows: (doc_id, text, lang, source)."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in EXTRA]])
    return spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * len(EXTRA)) for r in rows], schema)


def odd_rows():
    """Nulls, empty and very long texts, copies, near copies, repeated rows, shared passages."""
    shared = prose(99, 60)
    long = prose(1, 30_000)
    rows = [
        (1, None, "en", "a"), (2, "", None, None), (3, "  \t\n ", "en", "a"), (4, "One", "en", "b"), (5, "one two", None, "b"),
        (6, long, "en", "a"), (7, long, "en", "a"), (8, prose(2, 200), "fr", "b"), (8, prose(2, 200), "fr", "b"),
        (9, prose(3, 80) + " " + shared + " " + prose(4, 70), "en", "c"),
        (10, prose(5, 40) + " " + shared + " " + prose(6, 30), "en", None),
        (11, prose(7, 20) + "\n" + shared.replace(" ", "\n", 3), None, "a"),
        (12, shared + " " + shared, "de", "a"), (None, shared, "de", "a"), (None, None, None, None),
        (13, prose(8, 400), "en", "a"), (14, prose(8, 400) + " tail", "en", "a"), (15, "!!! ... 123", "en", "a"),
    ]
    rows += [(100 + i, prose(50, 120), "en", "hot") for i in range(40)]
    rows += [(200 + i, prose(300 + i, 60 + i), "en" if i % 2 else "fr", "hot") for i in range(30)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return make_docs(spark, odd_rows()).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return make_docs(spark, [])
