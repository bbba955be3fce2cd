"""Guarded tables: a write that breaks a constraint leaves the table as it was."""

import random

import pytest
from lumentab.operators import guarded
from lumentab.operators.web import titles_of_items
from lumentab.session import scratch_path
from pyspark.sql import functions as F

SCHEMA = "k int, v int, s string"


def content(table):
    return sorted((tuple(r) for r in table.read().collect()), key=repr)


def test_every_constraint_refuses_and_says_how_often(spark):
    parent = spark.createDataFrame([("a",), ("b",), (None,)], "name string")
    child = spark.createDataFrame([(1,), (1,), (None,)], "star int")
    rules = guarded.Constraints(not_null=["k"], unique=[["k"], ["v", "s"]], checks={"v": F.col("v") > 0},
                                references={"s": guarded.Reference(["s"], parent, ["name"])},
                                children={"planets": guarded.Child(child, ["star"], ["k"])})
    table = guarded.GuardedTable(spark, scratch_path(spark, "t"), rules)
    with pytest.raises(FileNotFoundError):
        table.read()
    with pytest.raises(guarded.ConstraintError) as e:
        table.create(spark.createDataFrame([(2, 1, "a")], SCHEMA))
    assert e.value.broken == {"child planets": 2}
    table.create(spark.createDataFrame([(1, 5, "a"), (2, None, "b"), (3, None, "b")], SCHEMA))
    before = content(table)
    for rows, broken in (
        ([(1, 6, "a"), (1, 7, "a"), (4, 8, "a"), (4, 9, "a")], {"unique k": 3}),
        ([(4, 5, "a")], {"unique v, s": 1}),
        ([(None, 6, None), (None, 7, None)], {"not null k": 2}),
        ([(4, 0, "z"), (5, -1, "z")], {"check v": 2, "reference s": 2}),
    ):
        with pytest.raises(guarded.ConstraintError) as e:
            table.insert(spark.createDataFrame(rows, SCHEMA))
        assert e.value.broken == broken and content(table) == before
    with pytest.raises(guarded.ConstraintError) as e:
        table.delete(F.col("k") == 1)
    assert e.value.broken == {"child planets": 2} and content(table) == before
    table.insert(spark.createDataFrame([(9,)], "k int"))
    table.update(F.col("k") == 9, {"v": F.lit(7)})
    table.delete(F.col("k") == 3)
    assert content(table) == sorted([(1, 5, "a"), (2, None, "b"), (9, 7, None)], key=repr)
    with pytest.raises(ValueError):
        table.insert(spark.createDataFrame([(1, 2)], "k int, other int"))
    table.delete(F.lit(False))
    assert len(content(table)) == 3


def test_random_batches_against_a_dictionary(spark):
    rng = random.Random(5)
    table = guarded.GuardedTable(spark, scratch_path(spark, "t"), guarded.Constraints(unique=[["k"]], checks={"v": F.col("v") < 9}))
    table.create(spark.createDataFrame([], "k int, v int"))
    mine = []
    for _ in range(6):
        batch = [(rng.choice([None, *range(20)]), rng.choice([None, *range(10)])) for _ in range(3)]
        keys = [k for k, _ in mine + batch if k is not None]
        good = len(keys) == len(set(keys)) and all(v is None or v < 9 for _, v in batch)
        try:
            table.insert(spark.createDataFrame(batch, "k int, v int"))
            assert good
            mine += batch
        except guarded.ConstraintError:
            assert not good
        assert content(table) == sorted(mine, key=repr)


def test_second_writer_of_a_version_is_told_and_a_dead_writer_does_not_count(spark):
    table = guarded.GuardedTable(spark, scratch_path(spark, "t"))
    table.create(spark.range(3).toDF("k"))
    number, parts = table._current()
    table.insert(spark.range(1).toDF("k"))
    with pytest.raises(guarded.ConcurrentWrite):
        table._commit(spark.range(1).toDF("k"), number, parts, None)
    assert table.read().count() == 4
    table._fs.create(table._file("_versions/.draft"), False).close()
    assert table.read().count() == 4
    table.insert(spark.range(1).toDF("k"))
    assert table.read().count() == 5


def test_titles_of_marked_items(spark):
    pod = '<article class="pod big"><p class="star {}"></p><h3><a>x</a><a title="{}">y</a></h3></article>'
    page = pod.format("Two", "one") + pod.format("Three", "two") + '<div class="Two star"><a title="outside"></a></div>' + pod.format("a Two", "3 &amp; 4")
    df = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<article class=pod>")], "p int, h string")
    got = titles_of_items(df, "p", "h", "pod", ["star", "Two"]).collect()
    assert sorted((r.p, r.title) for r in got) == [(1, "3 & 4"), (1, "one")]
