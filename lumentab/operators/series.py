"""Time series: spectra, volatility, counts per day."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentab.operators.fourier import amplitudes


def periodogram(df: DataFrame, series: str, t: str, y: str, frequencies: Sequence[float]) -> DataFrame:
    """Fourier amplitude of the mean-subtracted series on a chosen grid.

    sum((y-m) cos) = sum(y cos) - m sum(cos), so mean and sums come from one
    aggregation.  A row meets the grid inside its task and is folded into one
    partial sum per series and frequency before the shuffle.
    """
    grid = F.explode(F.array(*[F.lit(float(f)) for f in frequencies])).alias("frequency")
    return _amplitudes(df.where(F.col(y).isNotNull() & F.col(t).isNotNull()).select(series, F.col(t).alias("t"), F.col(y).alias("y"), grid), series)


def spectrum(df: DataFrame, series: str, t: str, y: str, step: float) -> DataFrame:
    """Fourier amplitude of the mean-subtracted series at every frequency of ``fftfreq(N, step)``.

    N is the length of each series in steps, from its first to its last time; a time
    goes to the nearest step, values of one step are added, steps without a value add
    nothing.  Work is N log N a series (``fourier``).  The amplitude of a real series
    is even, so only the frequencies from 0 up are kept and the others are their
    mirror images.  A null series is a series; rows with a null time or value take no part.
    """
    rows = df.where(F.col(y).isNotNull() & F.col(t).isNotNull()).select(
        F.col(series).alias("series"), F.col(t).cast("double").alias("t"), F.col(y).cast("double").alias("y"))
    facts = rows.groupBy(F.col("series").alias("of")).agg(
        F.min("t").alias("t0"), F.avg("y").alias("mean"), (F.round((F.max("t") - F.min("t")) / step).cast("bigint") + 1).alias("n"))
    placed = rows.join(facts, F.col("series").eqNullSafe(F.col("of"))).groupBy(
        "series", "n", "mean", F.round((F.col("t") - F.col("t0")) / step).cast("bigint").alias("i")).agg(
        F.sum("y").alias("total"), F.count(F.lit(1)).alias("times"))
    half = amplitudes(placed.select("series", "n", "i", (F.col("total") - F.col("mean") * F.col("times")).alias("y")))
    # fftfreq has the highest frequency of an even N with the minus sign only
    signs = F.when(F.col("k") == 0, F.array(F.lit(1))).when(2 * F.col("k") == F.col("n"), F.array(F.lit(-1))).otherwise(F.array(F.lit(1), F.lit(-1)))
    return half.select("series", "n", "k", "size", F.explode(signs).alias("sign")).select(
        F.col("series").alias(series), (F.col("k") / (F.col("n") * step) * F.col("sign")).alias("frequency"), F.col("size").alias("amplitude"))


def _amplitudes(rows: DataFrame, series: str) -> DataFrame:
    """Amplitude per series and frequency of rows (series, t, y, frequency)."""
    angle = rows.select(series, "frequency", "y", (F.lit(-2 * math.pi) * F.col("frequency") * F.col("t")).alias("a"))
    waves = angle.select(series, "frequency", "y", F.cos("a").alias("c"), F.sin("a").alias("s"))
    sums = waves.groupBy(series, "frequency").agg(
        F.avg("y").alias("m"), F.sum(F.col("y") * F.col("c")).alias("yc"), F.sum(F.col("y") * F.col("s")).alias("ys"),
        F.sum("c").alias("c"), F.sum("s").alias("s"))
    amplitude = F.hypot(F.col("yc") - F.col("m") * F.col("c"), F.col("ys") - F.col("m") * F.col("s"))
    return sums.select(series, "frequency", amplitude.alias("amplitude"))


def sinusoids(t: Column, parts: Sequence[tuple[float, float, float]]) -> Column:
    """Test signal: sum of (amplitude, frequency, phase) sines."""
    total = F.lit(0.0)
    for amplitude, frequency, phase in parts:
        total = total + F.lit(amplitude) * F.sin(F.lit(2 * math.pi * frequency) * t + F.lit(phase))
    return total


def volatility(df: DataFrame, series: str, value: str, by: Sequence[Column] = ()) -> DataFrame:
    """Sample deviation of a series, over all time or per extra key."""
    return df.groupBy(series, *by).agg(F.stddev_samp(value).alias("volatility"))


def nova_residual(log_t2: Column, magnitude: Column) -> Column:
    """Magnitude above the fixed line 12.6 + 3.24 x."""
    return magnitude - (F.lit(12.6) + F.lit(3.24) * log_t2)
