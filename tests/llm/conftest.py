"""Small, explicit tables for the training-data operators."""

import random

import pytest

from stayframe.llm._stage import ensure_package

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session", autouse=True)
def packaged(spark):
    ensure_package(spark)


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of (doc_id, text[, lang[, source]])."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r))) for r in rows]
        return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in full], DOC)

    return make


def prose(seed: int, n: int, alphabet: str = "abcdefghij") -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(2, 6))) for _ in range(n))
