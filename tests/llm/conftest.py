import random

import pytest

pytest.importorskip("thicket.llm")


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, blank, tiny and very long texts, copies, near copies,
    repeated rows, and columns whose names operators use inside."""
    rng = random.Random(3)
    base = sentence(rng, 300)
    near = base.split(" ")
    near[7] = "changed"
    texts = [None, "", " \n\t ", "one", "one", "Two words", "TWO words", base, base.upper(), " ".join(near), sentence(rng, 300), sentence(rng, 40_000), "it's 12 中文 😀 don't\n\n  x", "<|endof", "'" * 500, "a" * 6000]
    rows = [(i, t, "en", "s", i) for i, t in enumerate(texts)]
    rows.append((50, "one", "en", "s", 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, h string, n long")
    return df


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
