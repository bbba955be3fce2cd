"""The distributed transform against numpy, with groups made small enough to be many."""

import numpy as np
import pytest
from lumentab.operators import fourier, series


@pytest.mark.parametrize("n", [4096, 4099, 1, 2, 3])
def test_equals_numpy_at_powers_and_primes(spark, n, monkeypatch):
    monkeypatch.setattr(series, "amplitudes", lambda cells: fourier.amplitudes(cells, most=512))
    y = np.random.default_rng(n).normal(size=n) + 3
    df = spark.createDataFrame([(7, i, float(v)) for i, v in enumerate(y)], "s int, t long, y double")
    got = {round(r["frequency"] * n): r["amplitude"] for r in series.spectrum(df, "s", "t", "y", 1.0).collect()}
    want = dict(zip(np.round(np.fft.fftfreq(n, 1.0) * n).astype(int), np.abs(np.fft.fft(y - y.mean()))))
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-7 for k in want)


def test_gaps_repeats_null_series_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(series, "amplitudes", lambda cells: fourier.amplitudes(cells, most=16))
    rows = [(None, 0.0, 1.0), (None, 0.0, 2.0), (None, 500.0, 4.0), (None, 3.0, None), (2, None, 1.0), (5, 9.0, 3.0)]
    df = spark.createDataFrame(rows, "s int, t double, y double")
    got = series.spectrum(df, "s", "t", "y", 1.0).collect()
    x = np.zeros(501)
    x[0], x[500] = 3.0 - 2 * 7 / 3, 4.0 - 7 / 3
    want = dict(zip(np.round(np.fft.fftfreq(501, 1.0) * 501).astype(int), np.abs(np.fft.fft(x))))
    mine = {round(r["frequency"] * 501): r["amplitude"] for r in got if r["s"] is None}
    assert set(mine) == set(want) and all(abs(mine[k] - want[k]) < 1e-9 for k in want)
    assert [(r["frequency"], r["amplitude"]) for r in got if r["s"] == 5] == [(0.0, 0.0)]
    assert {r["s"] for r in got} == {None, 5}
    assert series.spectrum(df.limit(0), "s", "t", "y", 1.0).count() == 0


def test_no_frequency_meets_all_rows(spark):
    df = spark.range(64).selectExpr("1 AS s", "id AS t", "double(id) AS y")
    plan = series.spectrum(df, "s", "t", "y", 1.0)._jdf.queryExecution().optimizedPlan().toString()
    # the only generated rows before the last step are the blocks
    assert "NestedLoop" not in plan and plan.count("FlatMapGroupsInPandas") == 4
