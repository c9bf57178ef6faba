import random

import pytest

random.seed(4)
WORDS = [f"w{i}" for i in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, short and very long texts, repeated rows, copies, near copies, clashing extra columns."""
    base = prose(120, 1)
    near = base.split(" ")
    rows = [
        (1, base, "en", "a"), (2, base.upper(), "en", "a"), (3, " ".join(near[:60] + ["new"] + near[61:]), "en", "b"), (4, prose(80, 2), "de", "b"),
        (5, None, None, None), (6, "", "en", None), (None, "some text without an id", "fr", "a"), (8, " \n\t ", "en", "c"), (9, "one two", "en", "c"), (10, "one two", "en", "c"),
        (10, "one two", "en", "c"), (11, prose(60_000, 3), "en", "d"), (12, "ünïcode ▁ mark  double\u00a0space 世界 🙂\r\n\tx", "en", "d"), (13, "<|endoftext|> x", "en", "d"), (14, "a b c d e", None, "d"), (15, "A B C D E", "es", "d"),
    ]
    return spark.createDataFrame([(*r, 7, "own", 0.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, h double")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
