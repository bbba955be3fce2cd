"""Statistics.  Standard deviations are sample unless a name says population."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentab.functions.numbers import pearson
from lumentab.operators.joins import checked_broadcast
from lumentab.operators.ranking import exact_quantiles


def group_stats(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """count, mean, std, min, max, sum of each value column; NULL keys are dropped."""
    kept = df.where(" AND ".join(f"`{k}` IS NOT NULL" for k in by)) if by else df
    fns = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}
    return kept.groupBy(*by).agg(*[f(v).alias(f"{v}_{n}") for v in values for n, f in fns.items()])


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, exact quartiles and max, globally or per group."""
    by = list(by)
    basic = df.groupBy(*by).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    quart = exact_quantiles(df, value, [0.25, 0.5, 0.75], by, ["p25", "p50", "p75"])
    order = [*by, "count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    if by:
        return basic.join(quart, by, "left").select(*order)
    one = quart.agg(F.struct(*[F.max(c).alias(c) for c in ("p25", "p50", "p75")])).scalar()
    return basic.withColumns({c: one.getField(c) for c in ("p25", "p50", "p75")}).select(*order)


def describe_strings(df: DataFrame, value: str) -> DataFrame:
    """count, unique, top and freq of a string column; ties go to the smallest."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min(F.struct((-F.col("n")).alias("m"), F.col(value).alias("v"))).alias("t"),
    ).select("count", "unique", F.col("t.v").alias("top"), (-F.col("t.m")).alias("freq"))


def transpose_summary(df: DataFrame, label: str, labels: Sequence, stats: Sequence[str]) -> DataFrame:
    """Swap rows and columns of a small summary table."""
    long = df.unpivot([label], list(stats), "stat", "v")
    return long.groupBy("stat").pivot(label, list(labels)).agg(F.first("v"))


def value_counts(df: DataFrame, value: str, out: str = "n") -> DataFrame:
    """Counts, largest first; NULL is not counted, ties are ordered by value."""
    return (
        df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias(out))
        .orderBy(F.col(out).desc(), F.col(value).asc())
    )


def count_singletons(df: DataFrame, value: str) -> DataFrame:
    """How many values occur exactly once."""
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") == 1).alias("singletons"))


def pivot_table(df: DataFrame, index: str, columns: str, value: str, labels: Sequence, agg=F.avg) -> DataFrame:
    """Pivot with a given label list; the default aggregate is the mean."""
    return df.groupBy(index).pivot(columns, list(labels)).agg(agg(value))


def rows_at_max(df: DataFrame, value: str) -> DataFrame:
    """All rows that hold the largest value (every tie), by a scalar sub-query."""
    return df.where(F.col(value) == df.agg(F.max(value)).scalar())


def extreme_per_group(df: DataFrame, by: str, value: str, label: str, largest: bool = True) -> DataFrame:
    """Label of the extreme value per group; a tie goes to the smallest label.

    The extreme of each group is one row; the rows that hold it are found by a
    second scan and a join with that short table, so both shuffles carry only
    partial results of tasks.
    """
    edge = (F.max if largest else F.min)(value)
    extremes = checked_broadcast(df.where(F.col(value).isNotNull()).groupBy(by).agg(edge.alias("__edge")).withColumnRenamed(by, "__by"))
    held = df.join(extremes, df[by].eqNullSafe(extremes["__by"]) & (df[value] == extremes["__edge"]))
    return held.groupBy(by).agg(F.min(label).alias(label), F.first(value).alias(value))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson r of every pair of columns, long form, from a single aggregation; NULL beside a constant column."""
    pairs = [(a, a) for a in columns] + list(combinations(columns, 2))
    row = df.agg(*[pearson(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        cells.append((a, b, f"r{i}"))
        if a != b:
            cells.append((b, a, f"r{i}"))
    made = F.array(*[F.struct(F.lit(a).alias("c1"), F.lit(b).alias("c2"), F.col(r).alias("r")) for a, b, r in cells])
    return row.select(F.inline(made))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean with weights; rows where either is NULL do not count."""
    both = value.isNotNull() & weight.isNotNull()
    return F.try_divide(F.sum(F.when(both, value * weight)), F.sum(F.when(both, weight)))


def stack_mean(frames: Sequence[DataFrame]) -> DataFrame:
    """Element-wise mean of equally shaped long matrices (i, j, v)."""
    stacked = frames[0]
    for f in frames[1:]:
        stacked = stacked.unionByName(f)
    return stacked.groupBy("i", "j").agg(F.avg("v").alias("v"))


def linear_fit(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Ordinary least squares line per group."""
    return df.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def table_profile(df: DataFrame) -> DataFrame:
    """Column name, type, non-NULL count and row count; one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(f"`{c}`").alias(c) for c in df.columns])
    cells = F.array(*[
        F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("column_type"),
                 F.col(f"`{f.name}`").alias("non_null"), F.col("__rows").alias("row_count"))
        for f in df.schema])
    return counts.select(F.inline(cells))


def sparsity(df: DataFrame, row: str, col: str) -> DataFrame:
    """1 - filled cells / (rows * columns) of a long matrix, and percent filled."""
    cells = df.select(row, col).distinct()
    n = cells.agg(F.count(F.lit(1)).alias("nnz"), F.count_distinct(row).alias("n_rows"), F.count_distinct(col).alias("n_cols"))
    full = F.col("n_rows").cast("double") * F.col("n_cols")
    return n.withColumns({"sparsity": 1 - F.col("nnz") / full, "percent_filled": F.col("nnz") / full * 100})
