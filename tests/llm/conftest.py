import random

import pytest

WORDS = "the of and river stone light green under house walk seven paper north cloud table seed iron glass".split()
CLASHES = "score predicted key kind text_key shard slot row matches pieces spans n label block home v sig copies".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) * rng.randrange(2) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Documents with copies, near copies, nulls, empty, blank and very long texts, repeated rows and null ids."""
    rng = random.Random(5)
    base = [prose(rng, 60) for _ in range(30)]
    near = [" ".join(w if k != 7 else "changed" for k, w in enumerate(t.split())) for t in base[:10]]
    chain = [base[0].rsplit(" ", k)[0] for k in range(1, 12)]
    odd = [None, "", " \t\n ", "one", "one two", "ONE  two", "ünï ▁ çødé 日本語 \U0001f600", prose(rng, 30_000), "x" * 50_000, "a " * 3_000]
    rows = [(k, t) for k, t in enumerate(base + near + chain + base[5:9] + odd)]
    return rows + [rows[3], rows[3], (None, base[2]), (None, "nobody's"), (1, "another text of the id one")]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """``texts`` as a table with further columns, named like some that operators use inside."""
    extra = ", ".join(f"{c} string" for c in CLASHES)
    return spark.createDataFrame([(i, t, *["x"] * len(CLASHES)) for i, t in texts], f"doc_id long, text string, {extra}").repartition(3)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
