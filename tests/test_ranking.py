import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumentab.operators import ranking
from lumentab.operators.distribution import boxplot, hexbin, histogram, histogram2d, kernel_density


def values():
    rng = np.random.default_rng(3)
    hot = np.full(1000, 7.0)  # a third of all rows share one value
    return np.concatenate([hot, rng.exponential(10, 1500), rng.integers(0, 5, 500).astype(float)])


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_quantiles_do_not_depend_on_the_partitioning(spark, parts):
    v = values()
    df = spark.createDataFrame(pd.DataFrame({"v": v})).repartition(parts)
    row = ranking.exact_quantiles(df, "v", [0, 0.1, 0.25, 0.5, 0.9, 1]).first()
    assert list(row) == pytest.approx(list(np.quantile(v, [0, 0.1, 0.25, 0.5, 0.9, 1])))


def test_quantiles_per_group_with_null_nan_and_single_rows(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", None), ("b", 5.0), ("c", float("nan")), (None, 3.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.q0 for r in ranking.exact_quantiles(df, "v", [0.5], ["k"]).collect()}
    assert got == {"a": 1.5, "b": 5.0, None: 3.5}


def test_quantiles_of_an_empty_frame(spark):
    df = spark.createDataFrame([], "v double")
    assert ranking.exact_quantiles(df, "v", [0.5]).count() == 0


@pytest.mark.parametrize("ascending", [True, False])
def test_row_numbers_with_a_hot_value_and_nulls(spark, ascending):
    pdf = pd.DataFrame({"v": values()})
    pdf["id"] = np.random.default_rng(4).permutation(len(pdf))
    df = spark.createDataFrame(pdf).withColumn("v", F.when(F.col("id") % 50 != 0, F.col("v"))).repartition(9)
    got = ranking.with_row_number(df, "v", tie="id", ascending=ascending).toPandas().sort_values("rn")
    want = df.toPandas().sort_values(["v", "id"], ascending=[ascending, True], na_position="last")
    assert got["rn"].tolist() == list(range(1, len(pdf) + 1))
    assert got["id"].tolist() == want["id"].tolist()


def test_a_shared_value_and_nulls_are_ordered_in_parts(spark):
    df = spark.range(6000).withColumn("v", F.when(F.col("id") % 3 != 0, 1.0))  # one value and NULL
    numbered = ranking.with_row_number(df, "v", tie="id")
    got = numbered.orderBy("rn").select("rn", "id").collect()
    want = [i for i in range(6000) if i % 3] + list(range(0, 6000, 3))
    assert [r.id for r in got] == want and [r.rn for r in got] == list(range(1, 6001))
    # the ordering window is partitioned by slot and part, never by the whole frame
    window = [line for line in numbered._jdf.queryExecution().executedPlan().toString().splitlines() if "row_number()" in line]
    assert window and all("__slot" in line and "__sub" in line for line in window)


def test_first_reaching_half_of_the_weight(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"r": rng.uniform(0, 9, 800), "m": rng.uniform(1, 2, 800)}).sort_values("r")
    want = pdf["r"][pdf["m"].cumsum() >= pdf["m"].sum() / 2].iloc[0]
    assert ranking.first_reaching(spark.createDataFrame(pdf), "r", "m", 0.5).first()[0] == pytest.approx(want)


def test_histogram_closes_the_last_bin_and_survives_a_constant(spark):
    df = spark.createDataFrame([(float(x),) for x in range(11)], "v double")
    assert {r.bin: r.n for r in histogram(df, "v", 10).collect()} == {**{k: 1 for k in range(9)}, 9: 2}
    flat = spark.createDataFrame([(2.0,)] * 5, "v double")
    assert [(r.bin, r.n) for r in histogram(flat, "v", 10).collect()] == [(0, 5)]


def test_boxplot_whiskers(spark):
    data = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0, 100.0]
    row = boxplot(spark.createDataFrame([("g", x) for x in data], "g string, v double"), "v", ["g"]).first()
    q1, med, q3 = np.quantile(data, [0.25, 0.5, 0.75])
    assert (row.q1, row.med, row.q3) == (q1, med, q3)
    assert row.n_outliers == sum(x > q3 + 1.5 * (q3 - q1) for x in data)


def test_constant_columns_do_not_divide_by_zero(spark):
    df = spark.createDataFrame([(2.0, 3.0)] * 4, "x double, y double")
    assert [r.n for r in hexbin(df, "x", "y").collect()] == [4]
    assert {r.density for r in kernel_density(df, "x", 3).collect()} == {None}
    assert [r.n for r in histogram2d(df, "x", "y", (5, 5)).collect()] == [4]
