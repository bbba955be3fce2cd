"""Ordered windows over series that are already reduced to one row per step.

The callers aggregate to one row per (series, date) first; a series then has at
most as many rows as there are dates, whatever the size of the raw table.
Running totals over one long axis need no series: they run in slots.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentab.operators.ranking import _with_slot, cut_points


def daily_panel(df: DataFrame, series: str, ts: str, value: str) -> DataFrame:
    """(series, day) with open-to-close style aggregates of a raw table."""
    return df.groupBy(F.col(series).alias("series"), F.to_date(ts).alias("day")).agg(
        F.avg(value).alias("close"), F.max(value).alias("high"), F.min(value).alias("low"),
        F.sum(value).alias("volume"), F.count(F.lit(1)).alias("n"))


def pct_change(df: DataFrame, series: str, order_by: str, value: str, out: str = "change") -> DataFrame:
    """Relative change to the previous step; NULL on the first."""
    w = Window.partitionBy(series).orderBy(order_by)
    return df.withColumn(out, F.try_divide(F.col(value), F.lag(value).over(w)) - 1)


def rolling(value: str, rows: int, series: str, order_by: str, agg=F.avg) -> Column:
    """Aggregate of the last ``rows`` steps; NULL until that many are there."""
    w = Window.partitionBy(series).orderBy(order_by).rowsBetween(-(rows - 1), 0)
    return F.when(F.count(value).over(w) == rows, agg(value).over(w))


def rolling_means(df: DataFrame, series: str, order_by: str, value: str, spans: Mapping[str, int]) -> DataFrame:
    """Several moving averages; the frames share one shuffle and one sort."""
    return df.withColumns({name: rolling(value, rows, series, order_by) for name, rows in spans.items()})


def bollinger(df: DataFrame, series: str, order_by: str, value: str, rows: int = 20, k: float = 2.0) -> DataFrame:
    """Rolling mean with a band of ``k`` sample deviations."""
    mid = rolling(value, rows, series, order_by)
    dev = rolling(value, rows, series, order_by, F.stddev_samp)
    return df.withColumns({"mid": mid, "dev": dev}).withColumns({
        "upper": F.col("mid") + k * F.col("dev"), "lower": F.col("mid") - k * F.col("dev")}).drop("dev")


def running_totals(df: DataFrame, order_by: str, columns: Sequence[str], following: str | None = None) -> DataFrame:
    """Cumulative sums ``cum_*`` along a unique numeric column, in two levels.

    The axis is cut into slots.  Sums run inside a slot; the totals of the slots,
    one row each and no more than there are cut points, run once and are added.
    With ``following``, the next value of ``order_by`` comes along, NULL on the
    last row.  ``df`` is read several times, so it should be a written table.
    """
    slot = "__slot"
    marked = _with_slot(df, order_by, cut_points(df, order_by), slot)
    totals = marked.groupBy(slot).agg(F.min(order_by).alias("__first"), *[F.sum(c).alias(f"__all_{c}") for c in columns])
    along = Window.orderBy(slot)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(slot, F.lead("__first").over(along).alias("__next"), *[
        F.sum(f"__all_{c}").over(before).alias(f"__before_{c}") for c in columns])
    inside = Window.partitionBy(slot).orderBy(order_by)
    out = marked.join(F.broadcast(offsets), slot).withColumns({
        f"cum_{c}": F.sum(c).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.coalesce(f"__before_{c}", F.lit(0)) for c in columns})
    if following:
        out = out.withColumn(following, F.coalesce(F.lead(order_by).over(inside), "__next"))
    return out.drop(slot, "__next", *[f"__before_{c}" for c in columns])


def filled_steps(df: DataFrame, first: str, end: str, piece: int = 65_536) -> DataFrame:
    """One row for every whole number from ``first`` to ``end`` of a row, in place of ``first``.

    Long ranges are cut into pieces that are dealt over the tasks before they
    become rows, so no array is longer than ``piece`` or the number of pieces.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    step = F.lit(piece).cast("bigint")
    cut = df.withColumn(first, F.explode(F.sequence(F.col(first), F.col(end), step))).repartition(width, first)
    return cut.withColumn(first, F.explode(F.sequence(F.col(first), F.least(F.col(first) + step - 1, F.col(end))))).drop(end)
