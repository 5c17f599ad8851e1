import random

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with extra columns whose names clash with the operators' own."""

    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", "s", 1, "x", -1, "y") for i, t in zip(ids, texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int, fp string, rep int, spans string")

    return make


@pytest.fixture(scope="session")
def prose():
    rng = random.Random(7)
    parts = ["ti", "on", "the", "er", "an", "re", "eau", "ch", "ung", "ción", "ble", "st", "Q"]

    def make(n, seed):
        r = random.Random(seed)
        return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) + r.choice(["", "", ",", ".", "\n"]) for _ in range(n))

    del rng
    return make


EDGE = [None, "", " ", "\n\t\x0b\x1c", "a", "\u00a0", "é" * 50, "x" * 30000, "0" * 5000, "!?" * 500, "a b", "a b"]


@pytest.fixture(scope="session")
def edge():
    return EDGE
