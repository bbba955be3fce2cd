"""User functions over columns, groups and rows, and the line-oriented job.

Built-in expressions come first everywhere else; these operators are for the
function only the user has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def apply_column(df: DataFrame, column: str, fn: Callable[[pd.Series], pd.Series], kind: str, out: str) -> DataFrame:
    """Vectorised function of one column (Arrow batches)."""
    return df.withColumn(out, F.pandas_udf(fn, kind)(F.col(column)))


def apply_rows(df: DataFrame, columns: Sequence[str], fn: Callable[[pd.DataFrame], pd.Series], kind: str, out: str) -> DataFrame:
    """Vectorised function of several columns, given as one pandas frame per batch."""
    def on_frame(rows: pd.DataFrame) -> pd.Series:
        return fn(rows)

    return df.withColumn(out, F.pandas_udf(on_frame, kind)(F.struct(*columns)))


def aggregate_with(df: DataFrame, by: str, value: str, partial: Callable[[pd.Series], Sequence[float]],
                   parts: Sequence[str], finish: Callable[[dict[str, Column]], Column], out: str) -> DataFrame:
    """User aggregate in two phases: ``partial`` reduces a batch of one group to
    additive numbers, these are summed per group, ``finish`` combines the sums.

    No group is ever gathered: each task sends one row per group and batch.
    """
    names = list(parts)

    def reduce_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, *map(float, partial(values))) for key, values in batch.groupby("key", dropna=False)["value"]]
            yield pd.DataFrame(rows, columns=["key", *names])

    kind = df.schema[by].dataType.simpleString()
    reduced = df.select(F.col(by).alias("key"), F.col(value).alias("value")).where(F.col("value").isNotNull()).mapInPandas(
        reduce_batch, f"key {kind}, " + ", ".join(f"{p} double" for p in names))
    sums = reduced.groupBy("key").agg(*[F.sum(p).alias(p) for p in names])
    return sums.select(F.col("key").alias(by), finish({p: F.col(p) for p in names}).alias(out))


def apply_groups(df: DataFrame, by: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Function of a whole group.  The frame must be reduced so far that a group
    is bounded, for instance to one row per series and day."""
    return df.groupBy(by).applyInPandas(fn, schema)


def token_rows(df: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """One row per lower-cased token of two or more letters, digits or underscores, with its position; null has none."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return df.select(*keep, F.posexplode(tokens).alias("pos", "token"))


def line_fields(lines: DataFrame, column: str = "value") -> DataFrame:
    """Strip a leading ``#`` and split on runs of blanks."""
    bare = F.regexp_replace(F.trim(column), "^#", "")
    return lines.select(F.split(bare, r"\s+").alias("f"))


def sales_by_state(lines: DataFrame, column: str = "value") -> DataFrame:
    """Sum the amount (field 5) per state (field 3), largest first, header dropped.

    Amounts are numbers before they are added; a line without one is skipped.
    """
    rows = line_fields(lines, column).where(F.get("f", F.lit(0)) != "EventId").select(
        F.get("f", F.lit(3)).alias("state"), F.get("f", F.lit(5)).try_cast("double").alias("amount"))
    return (rows.where(F.col("amount").isNotNull()).groupBy("state").agg(F.sum("amount").alias("amount"))
            .orderBy(F.col("amount").desc(), "state"))
