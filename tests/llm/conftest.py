import random

import pytest

#: Null and empty texts, ties, repeated rows, one long text, copies and near copies.
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(5, 120)) for _ in range(40)]
    near = [b + " omega" for b in base[:8]]
    odd = [None, "", " \t\n", "one", "one two", "Straße, ñandú 日本語 <|endoftext|>", "a" * 700, "x y " * 300, prose(rng, 3000), "\x85odd\xa0spaces\u2003here \x1c x"]
    return base + base[:5] + near + odd


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, f"s{i % 3}" if i % 7 else None, float(i), "clash", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[:2], "doc_id long, text string, source string, score double, kept string, size int").repartition(3)


@pytest.fixture(scope="session")
def labels(spark, texts):
    rows = [(i, i % 2, int(i % 5 == 0)) for i in range(len(texts))] + [(None, 1, 1), (3, None, None), (4, 7, 0), (10_000, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
