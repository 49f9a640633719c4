import random

import pytest

EN = "the of and to in is that it for with on are this be by from at as have not but they his you which all were when".split()


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(EN) if rng.random() < 0.4 else "".join(rng.choice("abdeghilmnorstu") for _ in range(rng.randint(3, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def text():
    return prose


@pytest.fixture(scope="session")
def documents(spark):
    """Rows with nulls, empties, repeats, and columns that clash with those the operators add."""

    def make(rows):
        full = [(i, t, lang, src, None if t is None else len(t), "own") for i, t, lang, src in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept string")

    return make
