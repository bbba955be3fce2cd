import numpy as np
import pytest
from pyspark.sql import functions as F

from lumentab.operators import grid
from lumentab.operators import recommend as rec


def sparse(seed=8):
    rng = np.random.default_rng(seed)
    x = rng.integers(1, 9, (40, 30)) * (rng.uniform(size=(40, 30)) < 0.15).astype(float)
    x[:, 4], x[3] = 5, 2  # a column in every row and a row of all columns
    return x


@pytest.mark.parametrize("size", [{}, {"_ENTRIES": 30, "_STEP": 20, "_TABLE": 3}, {"_LEAST": 60, "_STEP": 50}])
def test_products_of_blocks_equal_dense_ones(spark, monkeypatch, size):
    """One block or many, slices that end inside a column, rows that are searched for; a row without a name, names that are strings."""
    for name, value in size.items():
        monkeypatch.setattr(grid, name, value)
    x = sparse()
    norm, n = np.linalg.norm(x, axis=0), np.linalg.norm(x, axis=1)
    cells = [(None if a == 39 else f"u{a}", f"i{b:02}", float(x[a, b]), False) for a, b in zip(*np.nonzero(x))]
    asked = [(f"u{a}", f"i{b:02}", float(a * b), True) for a in range(39) for b in range(0, 30, 2)] + [("u0", "unknown", 1.0, True), ("nobody", "i00", 1.0, True)]
    laid = grid.lay_out(grid.packed_rows(spark.createDataFrame(cells + asked, "row string, col string, val double, asked boolean").repartition(5)))
    assert (laid.n_cols, laid.n_rows, laid.total) == (30, 40, x.sum()) and (laid.n_blocks > 1) == bool(size)
    cosine = (x / norm).T @ (x / norm)
    got = [(int(r.a[1:]), int(r.b[1:]), r.v) for r in grid.cosines(laid).collect()]
    assert len({g[:2] for g in got}) == len(got) == (np.triu(x.T @ x, 1) != 0).sum() and all(a < b for a, b, _ in got)
    assert np.allclose([v for *_, v in got], [cosine[a, b] for a, b, _ in got])
    rows = grid.wanted_sums(laid).collect()
    assert len(rows) == 39 * 15
    u, y = np.where(np.arange(40)[:, None] < 39, x / n[:, None], 0), np.where(np.arange(40)[:, None] < 39, x, 0)
    near = u @ (u.T @ y - (u.T @ x.sum(1) / 30)[:, None])
    for r in rows:
        a, b = int(r.row[1:]), int(r.col[1:])
        want = (a * b, x[a].sum(), y[:, b].sum(), x[a] @ cosine[b], cosine[b].sum(), near[a, b], u[a] @ u.T @ np.ones(40))
        assert r.named and np.allclose((r.val, r.t, r.x, r.s, r.sv, r.g, r.us), want)


def test_many_items_shuffle_no_rows_for_their_bins(spark, monkeypatch):
    """The blocks meet in a Cartesian product of what is written once; nothing is dealt out behind it."""
    monkeypatch.setattr(rec, "BLOCK", 4)
    x = sparse()
    r = spark.createDataFrame([(int(a), int(b), float(x[a, b])) for a, b in zip(*np.nonzero(x))], "user long, item long, rating double")
    found = rec.cosine_pairs(r)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    cosine = (x / np.linalg.norm(x, axis=0)).T @ (x / np.linalg.norm(x, axis=0))
    rows = found.collect()
    assert len(rows) == (np.triu(x.T @ x, 1) != 0).sum()
    assert all(row.distance == pytest.approx(1 - cosine[row.item1, row.item2]) for row in rows)


@pytest.mark.parametrize("limit", [{"_ENTRIES": 30, "_MOST_BLOCKS": 2}, {"_CROWDED": 50}])
def test_too_many_or_crowded_blocks_go_another_way(spark, monkeypatch, limit):
    monkeypatch.setattr(rec, "BLOCK", 4)
    x = sparse()
    r = spark.createDataFrame([(int(a), int(b), float(x[a, b])) for a, b in zip(*np.nonzero(x))], "user long, item long, rating double")
    want = sorted((p.item1, p.item2, round(p.distance, 9)) for p in rec.cosine_pairs(r).collect())
    for name, value in limit.items():
        monkeypatch.setattr(grid, name, value)
    assert grid.lay_out(grid.packed_rows(rec._marked(r))) is None
    assert sorted((p.item1, p.item2, round(p.distance, 9)) for p in rec.cosine_pairs(r).collect()) == want


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("weights", ["distance", "similarity"])
def test_held_out_cells_come_with_their_ratings(spark, monkeypatch, weights, few):
    """As wanted cells of the other ratings; rows without a user or an item are on neither side."""
    monkeypatch.setattr(rec, "_SMALL_VECTORS", 2048 if few else 4)
    x = sparse()
    cells = [(int(a), int(b), float(x[a, b])) for a, b in zip(*np.nonzero(x))]
    r = spark.createDataFrame([*cells, (None, 3, 4.0), (2, None, 4.0), (1, 29, 0.0)], "user long, item long, rating double")
    held = (F.col("user") * 31 + F.col("item") * 17) % 5 == 0
    got = rec.predictions(r, ["item", "user"], weights, held_out=held)
    assert got.columns == ["user", "item", "rating", "item_pred", "user_pred"]
    monkeypatch.setattr(rec, "_SMALL_VECTORS", 2048)
    want = rec.predictions(r.where(~held), ["item", "user"], weights, wanted=r.where(held & (F.col("rating") != 0)).select("user", "item"))
    given = {c[:2]: c[2] for c in cells}
    want = {(p.user, p.item): (given[p.user, p.item], p.item_pred, p.user_pred) for p in want.collect()}
    rows = got.collect()
    assert len(rows) == len(want) > 20
    for p in rows:
        assert tuple(p)[2:] == pytest.approx(want[p.user, p.item])


def test_rmse_of_predictions_that_hold_their_ratings(spark):
    p = spark.createDataFrame([(1.0, 3.0), (2.0, 4.0), (0.0, 9.0)], "rating double, prediction double")
    assert tuple(rec.rmse(p).first()) == (2.0, 2)
