"""Joins.

Equi-joins are left to Catalyst: it compares the size of a side with
``spark.sql.autoBroadcastJoinThreshold`` and falls back to a sort-merge join,
whose hot partitions AQE splits.  Where the result allows it the plans
aggregate before they join, so a hot key crosses the network once per task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentab.session import ensure_checkpoint_dir

BROADCAST_ROWS = 100_000
#: of all values of a broadcast table, written out
BROADCAST_BYTES = 64 << 20


def checked_broadcast(small: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a reduced table only if it has been seen to be small.

    The size of an aggregate is not known before it ran, so a plain join would
    shuffle the large side as well.  The table is written once to the shared
    folder, counted and measured; beyond ``max_rows`` or ``BROADCAST_BYTES`` it is
    returned without the hint and the join is a sort-merge join.
    """
    ensure_checkpoint_dir(small.sparkSession)
    kept = small.checkpoint()
    rows, size = kept.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(kept) if rows <= max_rows and (size or 0) <= BROADCAST_BYTES else kept


def index_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join on the row label."""
    return left.join(right, key, how)


def align_add(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Label-aligned sum: union of labels, NULL where one side lacks the label."""
    b = right.select(key, F.col(value).alias("__other"))
    return left.select(key, value).join(b, key, "full").select(
        key, (F.col(value) + F.col("__other")).alias(value))


def concat_columns(frames: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Column-wise concat of frames on ``key``, columns prefixed by the frame name.

    The frames are tagged and stacked, then folded by one aggregation on the
    key, which needs one shuffle instead of a chain of full outer joins.  Each
    frame must hold a key once, as label-aligned concatenation demands.
    """
    stacked, names = None, []
    for tag, frame in frames.items():
        renamed = frame.select(key, *[F.col(c).alias(f"{tag}_{c}") for c in frame.columns if c != key])
        names += [c for c in renamed.columns if c != key]
        stacked = renamed if stacked is None else stacked.unionByName(renamed, allowMissingColumns=True)
    return stacked.groupBy(key).agg(*[F.max(c).alias(c) for c in names])


def theta_join(left: DataFrame, right: DataFrame, condition: Column | None, left_key: str,
               right_key: str, small_rows: int = 10_000, cells: int | None = None) -> DataFrame:
    """Join without an equality.

    If the right side has at most ``small_rows`` rows (checked by a bounded
    count) it is broadcast.  Beyond that both sides are laid out on a grid of
    ``cells`` x ``cells`` blocks (the one-bucket theta join of Okcan and
    Riedewald, 2011): a left row goes to every block of its grid row, a right
    row to every block of its grid column, and an equi-join on the block meets
    each pair exactly once with even load, whatever the value distribution.
    """
    if right.limit(small_rows + 1).count() <= small_rows:
        return left.join(F.broadcast(right), condition if condition is not None else F.lit(True))
    width = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    k = cells or max(2, math.isqrt(width))
    a = left.withColumn("__gr", F.pmod(F.xxhash64(left_key), F.lit(k))).withColumn(
        "__gc", F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<bigint>")))
    b = right.withColumn("__gc", F.pmod(F.xxhash64(right_key), F.lit(k))).withColumn(
        "__gr", F.explode(F.sequence(F.lit(0), F.lit(k - 1)).cast("array<bigint>")))
    met = a.join(b, ["__gr", "__gc"])
    if condition is not None:
        met = met.where(condition)
    return met.drop("__gr", "__gc")


def ratio_join(left: DataFrame, right: DataFrame, key: str, top: str, bottom: str, out: str = "ratio") -> DataFrame:
    """Equi-join and divide a right column by a left column; zero gives NULL."""
    return left.join(right, key).withColumn(out, F.try_divide(F.col(top), F.col(bottom)))


