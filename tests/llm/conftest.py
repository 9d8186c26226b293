import random

import pytest

EXTRA = ["id", "uid", "norm", "key", "fp", "block", "name", "n", "text_sha256", "label", "score", "batch", "chunk", "part", "source", "at"]


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(id, text): nulls, empty and long texts, ties, repeated rows, other scripts."""
    rng = random.Random(5)
    long = words(rng, 30_000)
    base = words(rng, 300)
    near = base.replace(" ", "\t", 3).upper()
    rows = [(None, "no id here"), (None, None), (1, None), (2, ""), (3, "  \n"), (4, "a  b\tc"), (5, "a b c"), (5, "a b c"), (6, long), (7, long + "!"), (8, long), (9, "жук über ñandú 漢字 🙂"), (10, base), (11, near), (-3, "a b c"), (12, "aaaa " * 3000)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The rows with extra columns whose names operators may use themselves."""
    extra = ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame([(i, t, *["x"] * len(EXTRA)) for i, t in odd_rows], f"doc_id long, text string, {extra}").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
