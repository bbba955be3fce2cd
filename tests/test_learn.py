import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumentab.operators import learn, neighbours


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(12)
    x = np.vstack([rng.normal(0, 0.1, (150, 3)), rng.normal(2, 1, (150, 3))])
    x[:60] = x[0]  # copies: equal distances rank by key
    return pd.DataFrame(x, columns=["a", "b", "c"]).assign(vec_id=np.arange(300), label=np.arange(300) % 3)


@pytest.mark.parametrize("pivots,piece", [(1, 8192), (8, 20), (32, 7)])
def test_neighbours_equal_brute_force(spark, cloud, pivots, piece):
    ask, ref = cloud[cloud.vec_id % 4 == 0], cloud[cloud.vec_id % 4 != 0]
    found = neighbours.nearest(spark.createDataFrame(ask), spark.createDataFrame(ref), "vec_id", ["a", "b", "c"], "label", 9,
                               pivots=pivots, piece_rows=piece).toPandas()
    cols = ["a", "b", "c"]
    for key, row in zip(ask.vec_id, ask[cols].to_numpy()):
        d = np.sqrt(((ref[cols].to_numpy() - row) ** 2).sum(1))
        want = ref.vec_id.to_numpy()[np.lexsort((ref.vec_id, d))[:9]]
        got = found[found["query"] == key].sort_values("rank")["neighbour"]
        assert got.tolist() == want.tolist()


def test_fewer_rows_than_neighbours(spark, cloud):
    found = neighbours.nearest(spark.createDataFrame(cloud[:2]), spark.createDataFrame(cloud[2:5]), "vec_id", ["a", "b", "c"], "label", 9)
    assert found.count() == 6


def test_vote_breaks_ties_by_label(spark):
    ranked = spark.createDataFrame([(1, 1, 5), (1, 2, 3), (1, 3, 5), (1, 4, 3)], "query int, rank int, label int")
    assert neighbours.vote(ranked, 1).first().prediction == 5
    assert neighbours.vote(ranked, 4).first().prediction == 3


def test_folds_and_splits_do_not_depend_on_the_partitioning(spark):
    df = spark.range(500)
    for parts in (1, 13):
        train, test = learn.split_rows(df.repartition(parts), "id", 0.3)
        assert train.count() + test.count() == 500
        first = sorted(r.id for r in test.collect()) if parts == 1 else first
        assert sorted(r.id for r in test.collect()) == first


def test_each_row_is_predicted_once(spark, cloud):
    data = learn.features(spark.createDataFrame(cloud).withColumn("label", F.col("label").cast("double")), ["a", "b", "c"])
    out = learn.out_of_fold(data, "vec_id", 3, learn.tree_classifier(depth=2).fit)
    assert out.count() == 300 and out.select("vec_id").distinct().count() == 300


def test_standardize_uses_the_fit_frame_and_constants_become_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, k double")
    fit = spark.createDataFrame([(0.0, 5.0), (4.0, 5.0)], "x double, k double")
    assert [tuple(r) for r in learn.standardize(df, ["x", "k"], fit).orderBy("x").collect()] == [(-0.5, 0.0), (0.5, 0.0)]


def test_report_of_a_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (1, 0)], "y int, p int")
    rows = {r.label: r for r in learn.classification_report(df, "y", "p").collect()}
    assert rows[1].precision == 0.0 and rows[1].recall == 0.0 and rows[1].support == 2
    assert rows[0].precision == pytest.approx(1 / 3)


def test_svm_grid_finds_a_ring(spark):
    rng = np.random.default_rng(1)
    p = rng.normal(0, 1, (200, 2))
    pdf = pd.DataFrame(p, columns=["x", "y"]).assign(vec_id=range(200), label=(np.hypot(p[:, 0], p[:, 1]) > 1.2).astype(float))
    got = learn.svm_grid(spark.createDataFrame(pdf), ["x", "y"], "label", "vec_id", [0.5], [0.001], folds=2)
    assert got.first().accuracy > 0.8


def test_svm_grid_makes_its_columns_once_for_all_gammas(spark, monkeypatch):
    machine = learn.LinearSVC
    monkeypatch.setattr(learn, "LinearSVC", lambda labelCol, maxIter: machine(labelCol=labelCol, maxIter=1))
    made = spark.sparkContext.accumulator(0)

    def counted(x):
        made.add(1)
        return x

    df = spark.range(0, 60, 1, 2).select(F.col("id").alias("vec_id"), (F.col("id") % 2).cast("double").alias("label"), F.udf(counted, "double")(F.sin("id")).alias("x"))
    got = learn.svm_grid(df, ["x"], "label", "vec_id", [0.5, 0.1], [0.001], folds=2).collect()
    assert [r.gamma for r in got] == [0.5, 0.1] and made.value == 60


def test_fourier_features_against_numpy(spark):
    x = np.random.default_rng(5).normal(size=(20, 3))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + [(20, 1.0, None, 2.0)], "k int, a double, b double, c double")
    rng = np.random.default_rng(7)
    w, shift = rng.normal(0.0, np.sqrt(2 * 0.3), (16, 3)), rng.uniform(0, 2 * np.pi, 16)
    got = learn.fourier_features(df, ["a", "b", "c"], 0.3, count=16).where("k < 20").orderBy("k").collect()
    assert np.allclose([r.features.toArray() for r in got], np.cos(x @ w.T + shift) * np.sqrt(2 / 16))


def test_centres_and_loadings_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, 0.1, (40, 3)) for m in (-5, 0, 5)]) * [1, 2, 3]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    cols = ["a", "b", "c"]
    got = learn.centres(learn.kmeans(df, cols, 3), df, cols).collect()
    means = sorted(tuple(x[i * 40:(i + 1) * 40].mean(0)) for i in range(3))
    mine = {}
    for r in got:
        mine.setdefault(r["prediction"], {})[r["column_name"]] = r["centre"]
        assert r["n"] == 40
    assert np.allclose(sorted(tuple(m[k] for k in cols) for m in mine.values()), means)

    model, scaled = learn.principal_components(df, cols, 2)
    z = (x - x.mean(0)) / x.std(0)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    for r in learn.loadings(model, scaled, cols).collect():
        v = vectors[:, -1 - r["component"]]
        v = v if v[np.abs(v).argmax()] > 0 else -v
        assert np.isclose(r["loading"], v[cols.index(r["column_name"])], atol=1e-6)
        assert np.isclose(r["explained"], values[-1 - r["component"]] / values.sum())


@pytest.mark.parametrize("kind", ["plain", "far from zero", "many ties", "not finite"])
def test_closest_rows_equal_the_distances_from_differences(kind):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(70, 16)), rng.normal(size=(300, 16))
    if kind == "far from zero":
        x, y = x * 1e-3 + 1e6, y * 1e-3 + 1e6  # the product alone would lose all digits
    if kind == "many ties":
        x, y = x.round(), np.repeat(y[:30].round(), 10, axis=0)
    if kind == "not finite":
        y[5, 3] = np.nan
    d = neighbours._distances(x, y)
    want = d.argsort(axis=1, kind="stable")[:, :9]
    near, got = neighbours._closest(x, y, 9)
    assert (near == want).all() and (got == np.take_along_axis(d, want, axis=1)).all()


def test_depths_are_read_off_one_tree(spark, cloud, monkeypatch):
    data = learn.features(spark.createDataFrame(cloud).withColumn("label", F.col("a") * 2 + F.col("b")), ["b", "c"])
    train, test = learn.split_rows(data, "vec_id", 0.5)
    want = {}
    for depth in (1, 3, 6, 29):
        model = learn.tree_regressor(depth).fit(train)
        for name, part in (("train", train), ("test", test)):
            rows = model.transform(part).toPandas()
            want[depth, name] = (rows["prediction"] - rows["label"]).abs().median()
    grown = []
    grow = learn.tree_regressor
    monkeypatch.setattr(learn, "tree_regressor", lambda depth, label: grown.append(depth) or grow(depth, label))
    got = {(r["depth"], r["part"]): r["median_diff"] for r in learn.depth_sweep(train, test, [1, 3, 6, 29]).collect()}
    assert got == pytest.approx(want) and grown == [29]


def test_a_task_holds_a_bounded_number_of_distances(spark, cloud, monkeypatch):
    sizes, closest = spark.sparkContext.accumulator(0), neighbours._closest

    def watched(x, y, m):
        sizes.add(int(x.shape[0] * y.shape[0] > 600))
        return closest(x, y, m)

    monkeypatch.setattr(neighbours, "_closest", watched)
    monkeypatch.setattr(neighbours, "_CELLS", 600)
    df = spark.createDataFrame(cloud)
    assert neighbours.nearest(df, df, "vec_id", ["a", "b", "c"], "label", 9, pivots=1).count() == 2700
    assert sizes.value == 0


def test_forest_keeps_the_nodes_of_rows(spark):
    """Deep trees are the same whether rows are taken down from the root in every pass or not."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3))
    rows = [(*map(float, v), float(v[0] * v[1] > rng.normal() / 2)) for v in x]
    data = learn.features(spark.createDataFrame(rows, "a double, b double, c double, label double"), ["a", "b", "c"]).repartition(3).cache()
    forest = learn.forest_classifier(5, depth=30)
    assert forest.getCacheNodeIds()
    assert forest.fit(data).toDebugString.split(")", 1)[1] == forest.copy({forest.cacheNodeIds: False}).fit(data).toDebugString.split(")", 1)[1]
