"""The aggregates behind histograms, densities and box plots."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentab.operators.joins import checked_broadcast
from lumentab.operators.ranking import exact_quantiles


def _equal_width_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based bin; the last one is closed on the right, a zero range is bin 0."""
    width = hi - lo
    return F.when(width == 0, 0).otherwise(
        F.least(F.floor((x - lo) / F.nullif(width, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int"))


def _edges(lo: Column, hi: Column, b: Column, bins: int) -> tuple[Column, Column]:
    step = (hi - lo) / bins
    return lo + step * b, lo + step * (b + 1)


def histogram(df: DataFrame, value: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram over [min, max] of the frame or of each group.

    Empty bins are absent.  The range of the whole frame is a scalar sub-query.
    Ranges per group are one small row each, joined to the rows as they are
    scanned; what is shuffled are the bin counts of each task.
    """
    by = list(by)
    clean = df.select(*by, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    ends = [F.min("__v").alias("lo"), F.max("__v").alias("hi")]
    if by:
        ranged = clean.join(checked_broadcast(clean.groupBy(*by).agg(*ends)), by)
    else:
        ranged = clean.withColumn("__r", clean.agg(F.struct(*ends)).scalar()).select("*", "__r.*")
    binned = ranged.withColumn("bin", _equal_width_bin(F.col("__v"), F.col("lo"), F.col("hi"), bins))
    counted = binned.groupBy(*by, "lo", "hi", "bin").agg(F.count(F.lit(1)).alias("n"))
    left, right = _edges(F.col("lo"), F.col("hi"), F.col("bin"), bins)
    return counted.select(*by, "bin", left.alias("left_edge"), right.alias("right_edge"), "n")


def histogram2d(df: DataFrame, x: str, y: str, bins: tuple[int, int]) -> DataFrame:
    """Counts on an equal-width grid over the range of both columns."""
    clean = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop()
    ends = clean.agg(F.struct(*[f(c).alias(n + c) for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])).scalar()
    bx = _equal_width_bin(F.col("x"), F.col("e.lox"), F.col("e.hix"), bins[0])
    by = _equal_width_bin(F.col("y"), F.col("e.loy"), F.col("e.hiy"), bins[1])
    return clean.withColumn("e", ends).groupBy(bx.alias("bx"), by.alias("by")).agg(F.count(F.lit(1)).alias("n"))


def hexbin(df: DataFrame, x: str, y: str, gridsize: int = 25) -> DataFrame:
    """Hexagonal counts: each point goes to the nearer centre of two offset lattices.

    Lattice 0 has its centres at whole grid steps, lattice 1 half a step off in
    both directions; the vertical distance counts three times (hexagon shape).
    """
    clean = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop()
    ends = clean.agg(F.struct(*[f(c).alias(n + c) for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])).scalar()
    ny = max(1, int(gridsize / math.sqrt(3)))
    u = F.coalesce(F.try_divide(F.col("x") - F.col("e.lox"), F.col("e.hix") - F.col("e.lox")), F.lit(0.0)) * gridsize
    v = F.coalesce(F.try_divide(F.col("y") - F.col("e.loy"), F.col("e.hiy") - F.col("e.loy")), F.lit(0.0)) * ny
    grid = clean.withColumn("e", ends).select(u.alias("u"), v.alias("v")).select(
        "u", "v", F.floor(F.col("u") + 0.5).alias("u0"), F.floor(F.col("v") + 0.5).alias("v0"),
        F.floor("u").alias("u1"), F.floor("v").alias("v1"))
    d0 = (F.col("u") - F.col("u0")) ** 2 + 3 * (F.col("v") - F.col("v0")) ** 2
    d1 = (F.col("u") - F.col("u1") - 0.5) ** 2 + 3 * (F.col("v") - F.col("v1") - 0.5) ** 2
    first = d0 < d1
    return grid.groupBy(
        F.when(first, 0).otherwise(1).alias("lattice"),
        F.when(first, F.col("u0")).otherwise(F.col("u1")).alias("hx"),
        F.when(first, F.col("v0")).otherwise(F.col("v1")).alias("hy"),
    ).agg(F.count(F.lit(1)).alias("n"))


def kernel_density(df: DataFrame, value: str, points: int = 25) -> DataFrame:
    """Gaussian density on ``points`` grid positions between min and max.

    Bandwidth (4 s^5 / 3 n)^(1/5) with the population deviation s; NULL densities
    where s is 0.  A row meets
    the fixed grid inside its task and is folded into one partial sum per grid
    point there; only those sums are shuffled.
    """
    clean = df.select(F.col(value).cast("double").alias("x")).where(F.col("x").isNotNull())
    stats = clean.agg(F.struct(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.stddev_pop("x").alias("s"), F.count("x").alias("n"))).scalar()
    grid = clean.withColumn("st", stats).select(
        "x", F.col("st.lo").alias("lo"), F.col("st.hi").alias("hi"), F.col("st.n").alias("n"),
        F.pow(4 * F.pow(F.col("st.s"), 5) / (3 * F.col("st.n")), F.lit(0.2)).alias("h"),
        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    at = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("k") / F.lit(float(points - 1)))
    d = grid.select("k", "n", "h", at.alias("at"), F.try_divide(F.col("x") - at, F.col("h")).alias("d"))
    sums = d.groupBy("k", "at", "n", "h").agg(F.sum(F.exp(-0.5 * F.col("d") * F.col("d"))).alias("s"))
    return sums.select("k", F.col("at").alias("x"), F.try_divide(F.col("s"), F.col("n") * F.col("h") * math.sqrt(2 * math.pi)).alias("density"))


def boxplot(df: DataFrame, value: str, by: Sequence[str], reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (last value within ``reach`` IQR) and outlier count per group.

    The quartiles are one row per group, broadcast if their number allows; the
    rows fold to one per group and task before the shuffle.
    """
    keys = list(by)
    quart = exact_quantiles(df, value, [0.25, 0.5, 0.75], keys, ["q1", "med", "q3"])
    rows = df.where(F.col(value).isNotNull()).select(*keys, value).join(checked_broadcast(quart), keys)
    span = (F.col("q3") - F.col("q1")) * reach
    inside = F.col(value).between(F.col("q1") - span, F.col("q3") + span)
    return rows.groupBy(*keys, "q1", "med", "q3").agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"))


def mass_function(df: DataFrame, mass: str, bins: int = 10) -> DataFrame:
    """Mean mass, count and width of equal-width bins, with the slope of
    log10(n/width) against log10(mean mass) and its standard error.

    Every row of the small bin table carries the fit.  Bins that hold no mass
    are absent; a single distinct mass gives one bin and no slope.
    """
    clean = df.select(F.col(mass).cast("double").alias("m")).where(F.col("m") > 0)
    ends = clean.agg(F.struct(F.min("m").alias("lo"), F.max("m").alias("hi"))).scalar()
    binned = clean.withColumn("e", ends).withColumn(
        "bin", _equal_width_bin(F.col("m"), F.col("e.lo"), F.col("e.hi"), bins))
    table = binned.groupBy("bin").agg(
        F.avg("m").alias("mean_mass"), F.count(F.lit(1)).alias("n"),
        ((F.max("e.hi") - F.max("e.lo")) / bins).alias("dm"))
    logs = table.select("*", F.log10("mean_mass").alias("lx"), F.log10(F.try_divide("n", "dm")).alias("ly"))
    k, sxx, r2, syy = (F.regr_count("ly", "lx"), F.regr_sxx("ly", "lx"), F.regr_r2("ly", "lx"), F.regr_syy("ly", "lx"))
    err = F.sqrt(F.try_divide(F.greatest((1 - r2) * syy, F.lit(0.0)), F.when(k > 2, (k - 2) * sxx)))
    fit = logs.agg(F.struct(F.regr_slope("ly", "lx").alias("slope"), err.alias("err"))).scalar()
    return table.withColumn("f", fit).select(
        "bin", "mean_mass", "n", "dm", F.col("f.slope").alias("slope"), F.col("f.err").alias("slope_err"))


def density_profile(df: DataFrame, radius: Column, mass: Column, step: float = 1.0) -> DataFrame:
    """Mass per volume of spherical shells of thickness ``step``."""
    shells = df.select(F.floor(radius / step).cast("int").alias("shell"), mass.alias("m"))
    r1, r2 = F.col("shell") * step, (F.col("shell") + 1) * step
    volume = F.lit(4 / 3 * math.pi) * (F.pow(r2, 3) - F.pow(r1, 3))
    return shells.groupBy("shell").agg(F.sum("m").alias("mass"), F.count(F.lit(1)).alias("n")).withColumn(
        "density", F.col("mass") / volume)
