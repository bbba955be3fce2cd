"""Table constraints as queries for their violations, and user-level DML as plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_null_violations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: how many rows break NOT NULL.  One pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column_name", "violations")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once (UNIQUE / PRIMARY KEY violations)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def check_violations(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the CHECK is false; unknown (NULL) passes."""
    return df.where(~condition)


def foreign_key_violations(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose non-NULL key has no parent."""
    parents = parent.select(F.col(parent_key).alias(key)).where(F.col(key).isNotNull()).distinct()
    return child.where(F.col(key).isNotNull()).join(parents, key, "left_anti")


def insert_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    """INSERT: columns the new rows lack are NULL."""
    return df.unionByName(rows, allowMissingColumns=True)


def update_where(df: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    """UPDATE .. SET .. WHERE: rows with an unknown condition are untouched."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """DELETE WHERE: rows with an unknown condition stay."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def set_cell(df: DataFrame, key: str, label, column: str, value) -> DataFrame:
    """Assign one cell by its row label."""
    return df.withColumn(column, F.when(F.col(key) == F.lit(label), F.lit(value)).otherwise(F.col(column)))
