import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", ".."))
sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, rank int, n_words string, __order int"


@pytest.fixture
def docs(spark):
    """Makes documents, with extra columns whose names clash with results, from (id, text[, source])."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, "x", 2) for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


def words(n, seed=0, size=10_000):
    import random

    r = random.Random(seed)
    return [f"w{r.randrange(size)}" for _ in range(n)]
