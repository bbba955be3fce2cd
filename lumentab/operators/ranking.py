"""Positions, exact quantiles and ordered running sums without a global window.

``Window.orderBy`` without a partition moves every row to one task, and
``percentile`` keeps all distinct values of a group in one buffer.  The
operators here cut the value axis into *slots* first.  The cut points are a
bounded number of approximate quantiles; a row's slot is a pure function of its
value, so the per-slot totals and the rows themselves can be computed in
separate branches and still agree after a lost executor.  Rows are then only
ever ordered inside one slot.  A value that occurs so often that it is itself a
cut point gets a slot of its own, which is divided further by the tie-break
column, so a value shared by a third of all rows is not one task either.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentab.operators.joins import checked_broadcast

_INF = float("inf")
_EXACT_DOUBLE = 2.0**53


def slot_count(df: DataFrame) -> int:
    """How many cut points to use: follows the shuffle width of the session."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(64, width)


def cut_points(df: DataFrame, value: str, n: int | None = None) -> list[float]:
    """At most ``n`` distinct interior cut points of a numeric or time column."""
    return sorted(set(_quantile_list(df, value, n)))


def _quantile_list(df: DataFrame, value: str, n: int | None) -> list[float]:
    """The quantiles behind the cut points; a frequent value is there several times."""
    n = n or slot_count(df)
    probs = [i / n for i in range(1, n)]
    numbers = df.select(_as_double(df, value).alias("v"))
    found = numbers.stat.approxQuantile("v", probs, 0.25 / n)
    return [p for p in found if p == p and abs(p) != _INF]


def _as_double(df: DataFrame, value: str) -> Column:
    kind = df.schema[value].dataType.typeName()
    c = F.col(value)
    if kind == "date":
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("double")
    if kind in ("timestamp", "timestamp_ntz"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if kind == "string":
        raise TypeError(f"order column {value} must be a number, date or timestamp")
    return c.cast("double")


def _with_slot(df: DataFrame, value: str, cuts: Sequence[float], out: str,
               copies: Sequence[int] | None = None) -> DataFrame:
    """Add the slot number: 2b for the cut point itself, 2b+1 for the gap above it.

    With ``copies``, one number per cut point, add it for rows at a cut point as
    the column ``out`` + "__copies" (1 elsewhere).
    """
    num, bucket = f"{out}__num", f"{out}__bucket"
    df = df.withColumn(num, _as_double(df, value))
    if not cuts:
        df = df.withColumn(out, F.lit(1)).drop(num)
        return df if copies is None else df.withColumn(f"{out}__copies", F.lit(1))
    splits = [-_INF, *cuts, _INF]
    df = Bucketizer(splits=splits, inputCol=num, outputCol=bucket, handleInvalid="keep").transform(df)
    b = F.col(bucket).cast("int")
    edge = F.get(F.array(*[F.lit(s) for s in splits]), b)
    df = df.withColumn(out, 2 * b + F.when(F.col(num) == edge, 0).otherwise(1))
    if copies is not None:
        at_cut = F.get(F.array(*[F.lit(int(k)) for k in (1, *copies, 1)]), b)
        df = df.withColumn(f"{out}__copies", F.when(F.col(num) == edge, at_cut).otherwise(1))
    return df.drop(num, bucket)


def with_row_number(
    df: DataFrame,
    order_by: str,
    tie: str | None = None,
    out: str = "rn",
    ascending: bool = True,
    slots: int | None = None,
) -> DataFrame:
    """Number all rows 1..n by ``order_by`` (then ``tie``), distributed over slots.

    ``order_by`` together with ``tie`` must be unique; without ``tie``,
    ``order_by`` alone must be.  NULL order keys come last.
    """
    slot, sub = "__slot", "__sub"
    often = Counter(_quantile_list(df, order_by, slots))
    cuts = sorted(often)
    marked = _with_slot(df, order_by, cuts, slot, [often[x] for x in cuts])
    missing = F.col(order_by).isNull()
    # numbers beyond 2**53 share a double: their cut slots hold several values
    single = all(abs(c) < _EXACT_DOUBLE for c in cuts)
    if tie is not None and single:
        tie_cuts = cut_points(df, tie, slots)
        marked = _with_slot(marked, tie, tie_cuts, sub)
        # a value that fills k quantiles is divided into k parts, so that all
        # parts together are no more than the quantiles; NULLs into all tie slots
        parts = F.floor(F.col(sub) * F.col(f"{slot}__copies") / F.lit(2 * len(tie_cuts) + 2)).cast("int")
        marked = marked.withColumn(sub, F.when(missing, F.col(sub)).otherwise(parts))
    else:
        marked = marked.withColumn(sub, F.lit(0))
    marked = marked.drop(f"{slot}__copies")
    # NULL order keys are kept in a slot of their own, behind all others
    marked = marked.withColumn(slot, F.when(missing, 2_000_000_000).otherwise(F.col(slot)))
    keys = [F.col(order_by).asc_nulls_last() if ascending else F.col(order_by).desc_nulls_last()]
    if tie is not None:
        keys.append(F.col(tie).asc())
    live = F.when(F.col(slot) == 2_000_000_000, 1).otherwise(0)
    rank_slot = F.col(slot) if ascending else -F.col(slot)
    before = (
        Window.orderBy(live, rank_slot, F.col(sub)).rowsBetween(Window.unboundedPreceding, -1)
    )
    # one row per slot: bounded by the number of cut points, not by the data
    offsets = (
        marked.groupBy(slot, sub).agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    inside = Window.partitionBy(slot, sub).orderBy(*keys)
    return (
        marked.join(F.broadcast(offsets), [slot, sub])
        .withColumn(out, F.row_number().over(inside).cast("bigint") + F.col("__before"))
        .drop(slot, sub, "__before")
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    names: Sequence[str] | None = None,
    slots: int | None = None,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    The first pass counts rows per group and slot, which map-side combining
    keeps small.  The second pass keeps only the rows of the few slots that hold
    a wanted rank, merges equal values and orders the rest inside their slot.
    """
    by = list(by)
    names = list(names or [f"q{i}" for i in range(len(probs))])
    clean = df.select(*by, F.col(value).cast("double").alias("__v")).where(
        F.col("__v").isNotNull() & ~F.isnan("__v")
    )
    counts = _with_slot(clean, "__v", cut_points(clean, "__v", slots), "__slot")

    key_cols = by or ["__all"]
    if not by:
        counts = counts.withColumn("__all", F.lit(1))
    run = Window.partitionBy(*key_cols).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    per_slot = (
        counts.groupBy(*key_cols, "__slot").agg(F.count(F.lit(1)).alias("__m"))
        .withColumn("__before", F.coalesce(F.sum("__m").over(run), F.lit(0)))
        .withColumn("__total", F.sum("__m").over(Window.partitionBy(*key_cols)))
    )
    # ranks (0-based) wanted of each group: floor and floor+1 of p*(n-1)
    wanted = F.array(*[
        F.struct(
            F.lit(i).alias("i"), F.lit(side).alias("side"),
            F.least(F.floor(F.lit(float(p)) * (F.col("__total") - 1)).cast("bigint") + side,
                    F.col("__total") - 1).alias("rank"),
        )
        for i, p in enumerate(probs) for side in (0, 1)
    ])
    targets = (
        per_slot.withColumn("__w", F.filter(
            wanted, lambda w: (w["rank"] >= F.col("__before"))
            & (w["rank"] < F.col("__before") + F.col("__m"))))
        .where(F.size("__w") > 0)
        .drop("__m")
    )
    inside = Window.partitionBy(*key_cols, "__slot").orderBy("__v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    # NULL group keys are groups too
    same = F.col("__slot") == F.col("__tslot")
    for k in key_cols:
        same = same & F.col(k).eqNullSafe(F.col(f"__t_{k}"))
    wanted_slots = targets.select(
        *[F.col(k).alias(f"__t_{k}") for k in key_cols], F.col("__slot").alias("__tslot"), "__before", "__total", "__w")
    # without groups these are at most two slots per quantile; else their number is checked
    wanted_slots = checked_broadcast(wanted_slots) if by else F.broadcast(wanted_slots)
    hits = (
        counts.join(wanted_slots, same)
        .groupBy(*key_cols, "__slot", "__before", "__total", "__w", "__v").agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__upto", F.sum("__n").over(inside) + F.col("__before"))
        .withColumn("__from", F.col("__upto") - F.col("__n"))
        .select(*key_cols, "__v", "__total", "__from", "__upto", F.explode("__w").alias("w"))
        .where((F.col("w.rank") >= F.col("__from")) & (F.col("w.rank") < F.col("__upto")))
    )

    def pick(i: int, side: int) -> Column:
        return F.max(F.when((F.col("w.i") == i) & (F.col("w.side") == side), F.col("__v")))

    outs = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.first("__total") - 1)
        frac = pos - F.floor(pos)
        lo, hi = pick(i, 0), pick(i, 1)
        outs.append((lo + (hi - lo) * frac).alias(names[i]))
    result = hits.groupBy(*key_cols).agg(*outs)
    return result.select(*by, *names)


def median_by(df: DataFrame, value: str, by: Sequence[str] = (), out: str = "median") -> DataFrame:
    """Exact median per group."""
    return exact_quantiles(df, value, [0.5], by, [out])


def first_reaching(
    df: DataFrame, value: str, weight: str, share: float, out: str = "reached", slots: int | None = None
) -> DataFrame:
    """Smallest ``value`` whose running ``weight`` reaches ``share`` of the total.

    Two passes: weight totals per slot locate the slot, then only the rows of
    that slot are put in order.
    """
    clean = df.select(F.col(value).alias("__v"), F.col(weight).cast("double").alias("__w")).where(
        F.col("__v").isNotNull() & F.col("__w").isNotNull()
    )
    sums = _with_slot(clean, "__v", cut_points(clean, "__v", slots), "__slot")
    run = Window.orderBy("__slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    target = (
        sums.groupBy("__slot").agg(F.sum("__w").alias("__s"))
        .withColumn("__cum", F.sum("__s").over(run))
        .withColumn("__need", F.sum("__s").over(whole) * F.lit(share))
        .where(F.col("__cum") >= F.col("__need"))
        .groupBy().agg(F.min(F.struct("__slot", "__cum", "__s", "__need")).alias("t"))
        .select("t.*")
        .select("__slot", (F.col("__cum") - F.col("__s")).alias("__before"), "__need")
    )
    inside = Window.partitionBy("__slot").orderBy("__v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (
        sums.join(F.broadcast(target), "__slot")  # a single row
        .groupBy("__slot", "__before", "__need", "__v").agg(F.sum("__w").alias("__w"))
        .withColumn("__cum", F.sum("__w").over(inside) + F.col("__before"))
        .where(F.col("__cum") >= F.col("__need"))
        .agg(F.min("__v").alias(out))
    )
