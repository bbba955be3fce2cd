"""Order, top-k and sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sort_sql(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """SQL ordering: NULLs last when ascending, first when descending."""
    c = F.col(column)
    return df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_first())


def top_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """First ``n`` rows of an explicit order (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def nth_row(df: DataFrame, order_by: str, n: int) -> DataFrame:
    """The n-th row (0-based) of an explicit order, for small ``n``."""
    return df.orderBy(order_by).offset(n).limit(1)


def random_key(key: Column, seed: int = 0) -> Column:
    """Stored-random-index stand-in: a linear congruential step of the row key."""
    bounded = F.pmod(key, F.lit(2147483648))
    return F.pmod(bounded * 1103515245 + (12345 + seed), F.lit(2147483648))


def random_top(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows in the order of a random index derived from the key."""
    ordered = df.withColumn("random_index", random_key(F.col(key), seed))
    return ordered.orderBy("random_index", key).limit(n)


def sample_exact(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows without replacement, repeatable for any partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def sample_fraction(df: DataFrame, fraction: float, key: str, seed: int = 0) -> DataFrame:
    """Bernoulli sample by key hash: repeatable for any partitioning."""
    buckets = 1_000_000
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(buckets)) < int(fraction * buckets))


def key_uniform(key: str, seed: int) -> Column:
    """A number in [0, 1) from 52 bits of a hash of seed and key: the same for any partitioning and on every retry."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def key_normal(key: str, seed: int) -> Column:
    """A standard normal number from two uniform ones (Box and Muller)."""
    return F.sqrt(-2 * F.ln(1 - key_uniform(key, seed))) * F.cos(2 * math.pi * key_uniform(key, seed + 1_000_003))


def sample_replaced(df: DataFrame, rate: float, key: str, seed: int = 0) -> DataFrame:
    """Sample with replacement: a row comes back as often as its Poisson number, drawn from its key, says."""
    steps, term = [math.exp(-rate)], math.exp(-rate)
    while 1 - steps[-1] > 2.0**-52 and term > 0:
        term *= rate / len(steps)
        steps.append(steps[-1] + term)
    times = sum((F.when(key_uniform(key, seed) >= s, 1).otherwise(0) for s in steps[1:]), F.when(key_uniform(key, seed) >= steps[0], 1).otherwise(0))
    drawn = df.withColumn("__n", times).where("__n > 0")
    return drawn.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__n")


def shuffle_rows(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """All rows in a repeatable random order (a distributed range sort)."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
