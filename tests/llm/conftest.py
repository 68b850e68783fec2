import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, a int, shard int"


def row(i, text, lang="en"):
    return (i, text, lang, "s", None if text is None else len(text), 0.5, "k", 1, 2)


@pytest.fixture(scope="session")
def rng():
    return random.Random(3)


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with those of results and inner steps."""
    return lambda pairs: spark.createDataFrame([row(*p) for p in pairs], SCHEMA)


@pytest.fixture(scope="session")
def prose():
    r = random.Random(11)
    vocabulary = ["".join(r.choices(["an", "be", "cho", "du", "er", "fi", "ga", "hu"], k=r.randint(1, 4))) for _ in range(900)]

    def say(n, seed):
        q = random.Random(seed)
        return " ".join(q.choice(vocabulary) for _ in range(n))

    return say


@pytest.fixture(scope="session")
def odd(make, prose):
    """Nulls in every column, empty, blank and very long texts, repeated rows."""
    base = [(1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "two words"), (6, prose(60_000, 1)), (7, prose(50, 2)), (7, prose(50, 2)), (None, "nothing known"), (8, "ünïcödé 字 " * 30)]
    docs = make(base)
    nulls = docs.sparkSession.createDataFrame([(None,) * 9], SCHEMA)
    return docs.union(nulls)
