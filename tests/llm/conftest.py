from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, n long, part int, hash string"


@pytest.fixture(scope="session")
def shipped(spark):
    from stagewise.llm.common import ship

    ship(spark)
    return spark


@pytest.fixture
def documents(shipped):
    """Rows of (doc_id, text[, lang[, source]]) as a table with extra columns of clashing names."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src", len(r[1] or ""), 7, "k", 1, 2, "h")
                for r in rows]
        return shipped.createDataFrame(full, DOCS)

    return make


def words(seed: int, count: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(2, 9))) for _ in range(count)]


ODD_ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "One  TWO"), (None, "one two three four five six"),
            (6, "one two three four five six"), (7, " ".join(words(1, 60_000))), (7, "other text of the same id"), (8, "émoji 😀 ünï \x1c x")]
