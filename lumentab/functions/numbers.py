"""Arithmetic with scripting-language rules, safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; NULL for divisor 0."""
    r = F.try_mod(a, b)
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def floor_div(a: Column, b: Column) -> Column:
    """Quotient rounded down (integers), exact beyond 2**53; NULL for divisor 0."""
    return F.when(b != 0, F.call_function("div", a - modulo(a, b), F.nullif(b, F.lit(0))))


def round_half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def fahrenheit(celsius: Column) -> Column:
    return celsius * F.lit(9 / 5) + 32


def line_length(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def line_slope(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """NULL for a vertical line."""
    return F.try_divide(y2 - y1, x2 - x1)


def pearson(a: Column, b: Column) -> Column:
    """Correlation over rows that have both values; NULL where a side is constant or fewer than two rows are left.

    ``corr`` divides by zero there, which is an error under ANSI rules.
    """
    mine, other = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.try_divide(F.covar_pop(a, b), F.stddev_pop(mine)), F.stddev_pop(other))
