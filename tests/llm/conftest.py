import random

import pytest

#: Columns that operators use names of inside.
CLASHING = ("shard", "slot", "size", "u", "id", "fp", "bucket", "row", "score", "line", "at", "k1", "host", "component", "n", "ids", "target", "copies", "y", "html")


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = "\n".join(prose(12) for _ in range(3000))
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 0), (4, long, "en", "b", len(long)), (5, "x", "en", "b", 1),
        (6, "Alpha beta gamma delta", "en", "b", 22), (7, "Alpha  beta\ngamma delta", "en", None, 23), (8, "Alpha betagamma delta", "de", "a", 21),
        (9, "É日本語 😀 ßtraße", "xx", "c", 12), (10, "1234 !!! ---", "en", "c", 12), (None, "no id at all here", "en", "a", 3), (11, prose(400), None, "c", None),
        (12, "<|endoftext|> a<|endoftext|>", "en", "a", 5), (12, "<|endoftext|> a<|endoftext|>", "en", "a", 5), (13, "same id, other text", "en", "b", 5), (13, "same id, another text", "en", "b", 5),
    ]
    rows += [(100 + i, "a copy of one text that is rather common", "en", "a", 40) for i in range(9)]
    return rows + [(200 + i, prose(30 + i), rng.choice(["en", "de"]), rng.choice(["a", "b", None]), i) for i in range(30)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    extra = ", ".join(f"{c} string" for c in CLASHING)
    rows = [(*r, *(f"{c}{k}" if k % 2 else None for c in CLASHING)) for k, r in enumerate(odd_rows)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {extra}").repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark, odd_rows):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(200, 230)] + [(None, 1, 1), (201, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
