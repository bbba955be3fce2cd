"""Suppression against all pairs, and a text with very many hits."""

import random

from lumentab.llm import licenses


def test_suppression_equals_all_pairs(spark):
    rng = random.Random(4)
    levels = sorted({r[4] for r in licenses.rules()})
    rows = []
    for row in range(60):
        for _ in range(rng.randint(1, 14)):
            start = rng.randint(0, 8)
            rows.append((row, start, start + rng.randint(1, 5), rng.choice("abc"), rng.choice(levels)))
    rows.append((99, None, None, None, None))

    def falls(x, y):
        if x[0] != y[0] or not (y[1] <= x[1] and x[2] <= y[2]):
            return False
        return y[4] > x[4] or y[4] == x[4] and (y[2] - y[1] > x[2] - x[1] or y[3] < x[3])

    want = sorted((*x, not any(falls(x, y) for y in rows[:-1])) for x in rows[:-1])
    df = spark.createDataFrame(rows, "row long, start int, end int, label string, priority int")
    got = licenses._with_kept(df).select("row", "start", "end", "label", "priority", "kept").collect()
    assert sorted(tuple(r) for r in got if r["start"] is not None) == want
    assert [r["kept"] for r in got if r["start"] is None] == [False]


def test_two_hundred_thousand_hits_in_one_text(spark):
    text = "under the mit license " * 100_000 + "cc by nc " * 100_000
    df = spark.createDataFrame([(1, text), (2, "nothing"), (2, "nothing"), (3, None)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.op8(df).collect())
    assert got == [(1, 700_000, 200_000, 0, 699_997, "cc-by-nc,mit"), (2, 1, 0, None, None, ""), (2, 1, 0, None, None, ""), (3, 0, 0, None, None, "")]
