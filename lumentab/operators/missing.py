"""Missing values.  NULL is the only mark of absence; NaN is turned into NULL first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentab.operators.joins import checked_broadcast


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN becomes NULL, as tables that mark absence by NaN need."""
    floats = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(subset) if subset else None)


def removal_report(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Rows kept and removed by ``drop_missing``, counted in one pass."""
    complete = F.lit(True)
    for c in subset:
        complete = complete & F.col(c).isNotNull()
    return df.agg(
        F.count_if(complete).alias("rows_kept"), F.count_if(~complete).alias("rows_removed")
    )


def keep_with_at_least(df: DataFrame, threshold: int) -> DataFrame:
    return df.na.drop(thresh=threshold)


def drop_missing_columns(df: DataFrame) -> DataFrame:
    """Drop each column that holds a NULL: one aggregate job, one row back."""
    row = df.agg(*[F.bool_or(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not row[c]])


def fill_with_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill with the column mean, taken as a scalar sub-query of the same input."""
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns])).scalar()
    return df.withColumns({c: F.coalesce(F.col(c), means.getField(c)) for c in columns})


def fill_with_group_mean(df: DataFrame, column: str, by: str) -> DataFrame:
    """Fill with the mean of the row's group; a group of only NULLs stays NULL."""
    means = checked_broadcast(df.groupBy(F.col(by).alias("__k")).agg(F.avg(column).alias("__mean")))
    joined = df.join(means, F.col(by).eqNullSafe(F.col("__k")), "left")
    return joined.withColumn(column, F.coalesce(F.col(column), F.col("__mean"))).drop("__k", "__mean")


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of NULLs per column, long form."""
    rates = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return rates.unpivot([], list(columns), "column_name", "null_rate")
