"""Set operations on rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_in_order(df: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values with the position where each is first seen."""
    return df.groupBy(value).agg(F.min(position).alias("first_pos"))


def _sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of both frames and whether each side holds them: one shuffle.

    Copies are folded per task by the aggregation itself; NULL rows compare equal.
    """
    tagged = left.withColumn("__left", F.lit(True)).unionByName(
        right.select(*left.columns).withColumn("__left", F.lit(False)))
    return tagged.groupBy(*left.columns).agg(
        F.bool_or("__left").alias("in_left"), F.bool_or(~F.col("__left")).alias("in_right"))


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that are in exactly one of two frames with equal columns."""
    return _sides(left, right).where(F.col("in_left") != F.col("in_right")).select(*left.columns)


def set_relations(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: is left a subset of right, a superset, are they disjoint."""
    return _sides(left, right).agg(
        (F.count_if(F.col("in_left") & ~F.col("in_right")) == 0).alias("is_subset"),
        (F.count_if(~F.col("in_left") & F.col("in_right")) == 0).alias("is_superset"),
        (F.count_if(F.col("in_left") & F.col("in_right")) == 0).alias("is_disjoint"),
    )
