import numpy as np
import pytest

from lumentab.operators import recommend as rec
from lumentab.operators import stripes


@pytest.mark.parametrize("size", [{}, {"_PIECE": 7, "_STEP": 20, "_BIN": 900}, {"_BIN": 40, "_LEAST": 20, "_STEP": 30}])
def test_products_stay_in_the_task_of_their_column(spark, monkeypatch, size):
    """Rows in one or several pieces, one or many bins, with and without columns that are cut over bins; a row without a name."""
    for name, value in size.items():
        monkeypatch.setattr(stripes, name, value)
    rng = np.random.default_rng(8)
    x = rng.integers(1, 9, (40, 30)) * (rng.uniform(size=(40, 30)) < 0.15).astype(float)
    x[:, 4], x[3] = 5, 2  # a column in every row and a row of all columns
    norm, n = np.linalg.norm(x, axis=0), np.linalg.norm(x, axis=1)
    u, i = np.nonzero(x)
    cells = spark.createDataFrame([(None if a == 39 else int(a), int(b), float(x[a, b]), float(norm[b])) for a, b in zip(u, i)], "row long, col long, val double, norm double")
    packed = stripes.packed_rows(cells.repartition(5))
    n_bins, hot, long_rows = stripes._bins(packed)
    assert (n_bins > 1, bool(hot)) == (bool(size), "_LEAST" in size) and long_rows == ("_PIECE" in size)
    cosine, named = (x / norm).T @ (x / norm), x[:39] / np.sqrt(n[:39, None])
    got = stripes.cosines(packed, 30).toPandas()
    assert len(got) == (np.triu(x.T @ x, 1) != 0).sum() and np.allclose(got["v"], cosine[got["a"], got["b"]])
    wanted = spark.createDataFrame([(a, b) for a in range(39) for b in range(0, 30, 2)], "row long, col long")
    sums, own = (f.toPandas() for f in stripes.wanted_sums(packed, 30, wanted))
    assert len(sums) == 39 * 15 and np.allclose(sums["s"], (x @ cosine)[sums["row"], sums["col"]])
    by_user = (x / n[:, None]) @ (named.T @ named)
    assert np.allclose(sums["g"] * norm[sums["col"]], by_user[sums["row"], sums["col"]])
    own = own.set_index("col")["sv"]
    assert np.allclose(own[range(0, 30, 2)], cosine.sum(0)[::2]) and len(own) == 30


def test_no_products_are_shuffled(spark, monkeypatch):
    """Beyond one block of items neither cosines nor wanted predictions make a row for a product before they have added it up."""
    monkeypatch.setattr(rec, "_SMALL_VECTORS", 4)
    monkeypatch.setattr(rec, "BLOCK", 4)
    monkeypatch.setattr(rec, "gram", None)
    rng = np.random.default_rng(3)
    x = rng.integers(1, 6, (25, 12)) * (rng.uniform(size=(25, 12)) < 0.5).astype(float)
    u, i = np.nonzero(x)
    r = spark.createDataFrame([(int(a), f"i{b:02}", float(x[a, b])) for a, b in zip(u, i)], "user long, item string, rating double")
    unit = x / np.linalg.norm(x, axis=0)
    cosine = unit.T @ unit
    rows = rec.cosine_pairs(r).collect()
    assert len(rows) == (np.triu(cosine, 1) > 0).sum()
    for row in rows:
        assert row.distance == pytest.approx(1 - cosine[int(row.item1[1:]), int(row.item2[1:])])
    want = x @ (1 - cosine) / (1 - cosine).sum(0)
    got = rec.predict(r, "item", wanted=r.select("user", "item")).collect()
    assert len(got) == len(u)
    for row in got:
        assert row.prediction == pytest.approx(want[row.user, int(row.item[1:])])
