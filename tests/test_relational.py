import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from lumentab.operators import integrity, joins, missing, relational as rel, setops
from lumentab.plans import REGISTRY
from lumentab.plans.registry import Tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("small_rows", [10_000, 3])
def test_theta_join_by_broadcast_and_by_grid(spark, small_rows):
    a, b = spark.range(40).toDF("a"), spark.range(30).toDF("b")
    got = joins.theta_join(a, b, F.col("a") < F.col("b"), "a", "b", small_rows=small_rows, cells=4)
    assert sorted((r.a, r.b) for r in got.collect()) == [(i, j) for i in range(40) for j in range(30) if i < j]


def test_aligned_sum_is_null_on_one_side(spark):
    one = spark.createDataFrame([("x", 1), ("y", 3)], "k string, v int")
    two = spark.createDataFrame([("x", 1), ("z", 5)], "k string, v int")
    assert {r.k: r.v for r in joins.align_add(one, two, "k", "v").collect()} == {"x": 2, "y": None, "z": None}


def test_check_and_dml_treat_unknown_as_sql_does(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 1)], "k int, v int")
    assert [r.k for r in integrity.check_violations(df, F.col("v") > 3).collect()] == [3]
    assert sorted(r.k for r in integrity.delete_where(df, F.col("v") > 3).collect()) == [2, 3]
    updated = integrity.update_where(df, F.col("v") > 3, {"v": F.lit(None).cast("int")})
    assert {r.k: r.v for r in updated.collect()} == {1: None, 2: None, 3: 1}


def test_missing_operators(spark):
    df = spark.createDataFrame([(4.0, 7.0, 1), (8.0, None, 2), (None, None, 3)], "A double, B double, C int")
    assert missing.drop_missing(df).count() == 1
    assert missing.drop_missing_columns(df).columns == ["C"]
    assert missing.keep_with_at_least(df, 2).count() == 2
    assert [r.A for r in missing.fill_with_mean(df, ["A"]).orderBy("C").collect()] == [4.0, 8.0, 6.0]
    nan = spark.createDataFrame([(float("nan"),)], "A double")
    assert missing.nan_to_null(nan).first().A is None


def test_symmetric_difference_and_relations_with_nulls(spark):
    a = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    b = spark.createDataFrame([(2,), (None,)], "k int")
    assert sorted(r.k for r in setops.symmetric_difference(a, b).collect()) == [1, 2]
    assert tuple(setops.set_relations(a, b).first()) == (False, False, False)


def test_dummies_drop_the_first_category_in_sort_order(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,)], "s string")
    assert rel.dummies(df, "s").columns == ["s", "b"]
    with pytest.raises(ValueError):
        rel.dummies(df, "s", limit=1)


def test_wrap_and_codes(spark):
    df = spark.createDataFrame([(350.0, 1), (-190.0, 9)], "ra double, code int")
    rows = df.select(rel.wrap_degrees(F.col("ra")).alias("w"), rel.map_codes(F.col("code"), {1: "one"}).alias("n")).collect()
    assert [tuple(r) for r in rows] == [(-10.0, "one"), (170.0, None)]


def test_plans_are_the_wanted_ones(spark):
    t = Tables(spark, SMALL)
    assert "TakeOrderedAndProject" in plan(REGISTRY["top_k"].build(t))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual" in plan(REGISTRY["date_slice"].build(t))
    pruned = plan(REGISTRY["computed_column"].build(t))
    assert "l_shipdate" not in pruned and "l_suppkey" not in pruned
    flagship = plan(REGISTRY["flagship"].build(t))
    assert flagship.index("HashAggregate") > flagship.index("Join")  # the aggregate feeds the join
    for name in ("join_inner", "histogram", "fillna_mean", "kde", "tfidf", "standardize"):
        assert "CartesianProduct" not in plan(REGISTRY[name].build(t))
        assert "NestedLoop" not in plan(REGISTRY[name].build(t))
