"""Queries do the whole of what the survey names, not a part of it."""

import numpy as np
from conftest import SMALL
from lumentab.operators import series
from lumentab.plans import REGISTRY, learning


def test_all_elements_are_read(spark):
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r["embedding"] for r in sorted(e, key=lambda r: r["vec_id"])], float)
    sums = {r["j"]: r["total"] for r in REGISTRY["matrix_sums_all"](spark, SMALL).collect()}
    assert sorted(sums) == list(range(-1, x.shape[1]))
    assert np.allclose([sums[j] for j in range(x.shape[1])], x.sum(0), atol=1e-4)
    assert REGISTRY["stack_mean_all"](spark, SMALL).count() == -(-len(x) // 3) * x.shape[1]
    assert REGISTRY["submatrix_all"](spark, SMALL).where("pos = -1").count() == 2 * (x.shape[1] - 1)


def test_spectrum_equals_fft(spark):
    rows, want = [], {}
    for name, n, step in (("even", 60, 0.5), ("odd", 75, 0.5), ("one", 1, 0.5)):
        t = 3 + np.arange(n) * step
        y = 2 + 7 * np.sin(2 * np.pi * 0.9 * t) + np.random.default_rng(n).normal(size=n)
        rows += [(name, float(a), float(b)) for a, b in zip(t, y)]
        want |= {(name, round(f, 9)): a for f, a in zip(np.fft.fftfreq(n, step), np.abs(np.fft.fft(y - y.mean())))}
    rows += [("even", None, 1.0), ("odd", 4.0, None)]
    got = series.spectrum(spark.createDataFrame(rows, "star string, t double, y double"), "star", "t", "y", 0.5).collect()
    assert len(got) == len(want)
    assert all(np.isclose(r["amplitude"], want[r["star"], round(r["frequency"], 9)], atol=1e-6) for r in got)


def test_peak_above_twelve_cycles_a_year_is_seen(spark):
    f = [r["frequency"] for r in REGISTRY["periodogram_full"](spark, SMALL).collect()]
    assert max(f) > 0.49 and min(f) < -0.49 and 0 in f


def test_model_queries_use_the_grids_of_the_reference(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(learning.learn, "depth_sweep", lambda a, b, depths: asked.update(depths=list(depths)) or a)
    monkeypatch.setattr(learning.learn, "out_of_fold", lambda d, key, folds, fit: asked.update(
        folds=folds, trees=fit.__self__.getNumTrees(), depth=fit.__self__.getMaxDepth()) or d.withColumn("prediction", d["label"]))
    monkeypatch.setattr(learning.learn, "svm_grid", lambda d, cols, label, key, gammas, penalties, folds: asked.update(
        gammas=list(gammas), ratio=[p / penalties[0] for p in penalties], svm_folds=folds) or spark.createDataFrame([(0.1,)], "penalty double"))
    for name in ("tree_depth_sweep", "forest_cv", "svm_grid"):
        REGISTRY[name](spark, SMALL)
    assert asked["depths"] == list(range(1, 30, 2)) and (asked["folds"], asked["trees"], asked["depth"]) == (10, 50, 30)
    assert asked["gammas"] == [1, 0.1, 0.01, 0.001, 0.0001] and asked["svm_folds"] == 5
    assert np.allclose(asked["ratio"], [1, 0.1, 0.01, 0.001, 0.0001])
