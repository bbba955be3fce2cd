"""Array and map expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_value(a: Column, x: Column) -> Column:
    return F.size(F.filter(a, lambda v: v == x))


def index_of(a: Column, x: Column) -> Column:
    """0-based position of the first equal element, NULL if absent."""
    return F.nullif(F.array_position(a, x), F.lit(0)) - 1


def remove_first(a: Column, x: Column) -> Column:
    """Remove the first equal element only; unchanged if there is none."""
    p = F.array_position(a, x).cast("int")
    return F.when(p > 0, F.concat(F.slice(a, F.lit(1), p - 1), F.slice(a, p + 1, F.size(a)))).otherwise(a)


def pop_last(a: Column) -> tuple[Column, Column]:
    """The array without its last element, and that element (NULL if empty)."""
    keep = F.greatest(F.size(a) - 1, F.lit(0))
    return F.slice(a, F.lit(1), keep), F.get(a, F.size(a) - 1)


def zip_shortest(a: Column, b: Column) -> Column:
    """Pairs up to the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, F.lit(1), n).alias("a"), F.slice(b, F.lit(1), n).alias("b"))


def product(a: Column) -> Column:
    return F.aggregate(a, F.lit(1.0), lambda acc, v: acc * v)


def digits_to_number(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("bigint"), lambda acc, v: acc * 10 + v)


def get_default(m: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(m, key), default)


def switch_map(m: Column) -> Column:
    """Swap keys and values; the values must be distinct."""
    return F.map_from_arrays(F.map_values(m), F.map_keys(m))
