"""Catalogue searches on the sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentab.functions.sky import angular_distance, ra_window
from lumentab.operators.joins import checked_broadcast
from lumentab.session import ensure_checkpoint_dir

_SLACK = 1e-9


def cone_search(df: DataFrame, ra: str, dec: str, ra0: float, dec0: float, radius: float,
                inclusive: bool = False, quality: Column | None = None) -> DataFrame:
    """Rows within ``radius`` degrees of a point, with the distance.

    The declination band and the right-ascension window are plain ranges on the
    columns, so they reach a Parquet scan; the exact test follows.
    """
    near = F.col(dec).between(dec0 - radius - _SLACK, dec0 + radius + _SLACK)
    if abs(dec0) + radius < 90:
        half = math.degrees(math.asin(math.sin(math.radians(radius)) / math.cos(math.radians(dec0)))) + _SLACK
        lo, hi = (ra0 - half) % 360, (ra0 + half) % 360
        window = F.col(ra).between(lo, hi) if lo <= hi else (F.col(ra) >= lo) | (F.col(ra) <= hi)
        near = near & window
    if quality is not None:
        near = near & quality
    dist = angular_distance(F.col(ra), F.col(dec), F.lit(float(ra0)), F.lit(float(dec0)))
    found = df.where(near).withColumn("dist", dist)
    return found.where(F.col("dist") <= radius if inclusive else F.col("dist") < radius)


def find_closest(df: DataFrame, key: str, ra: str, dec: str, ra0: float, dec0: float) -> DataFrame:
    """The nearest row to a point: one aggregation, smallest key on a tie."""
    dist = angular_distance(F.col(ra), F.col(dec), F.lit(float(ra0)), F.lit(float(dec0)))
    best = df.agg(F.min(F.struct(dist.alias("dist"), F.col(key).alias(key))).alias("b"))
    return best.select(f"b.{key}", "b.dist")


def _cell_count(zone: Column, height: float) -> Column:
    """Right-ascension cells of a declination zone, about as wide as it is high."""
    edge = F.greatest(F.abs(zone * F.lit(height) - 90), F.abs((zone + 1) * F.lit(height) - 90))
    cells = F.floor(360 * F.cos(F.radians(F.least(edge, F.lit(90.0)))) / F.lit(height))
    return F.when(edge + height >= 90, F.lit(1).cast("bigint")).otherwise(F.greatest(cells, F.lit(1).cast("bigint")))


def _zone(dec: Column, height: float) -> Column:
    return F.floor((dec + 90) / F.lit(height))


def _placed(points: DataFrame, ra: str, dec: str, height: float) -> DataFrame:
    """Each point in its one cell."""
    p = points.withColumn("zone", _zone(F.col(dec), height)).withColumn("__n", _cell_count(F.col("zone"), height))
    cell = F.least(F.floor(F.pmod(F.col(ra), F.lit(360.0)) / 360 * F.col("__n")), F.col("__n") - 1)
    return p.withColumn("cell", cell).drop("__n")


def _reaching(points: DataFrame, ra: str, dec: str, height: float) -> DataFrame:
    """Each point once per cell that its search circle of radius ``height`` can touch."""
    zones = F.explode(F.array(*[(_zone(F.col(dec), height) + k).alias("zone") for k in (-1, 0, 1)]))
    half = ra_window(F.col(dec), height) * (1 + _SLACK) + _SLACK
    p = points.withColumn("zone", zones).withColumn("__n", _cell_count(F.col("zone"), height)).withColumn("__w", half)
    turn = F.pmod(F.col(ra), F.lit(360.0))
    first = F.floor((turn - F.col("__w")) / 360 * F.col("__n"))
    last = F.floor((turn + F.col("__w")) / 360 * F.col("__n"))
    last = F.least(last, first + F.col("__n") - 1)  # never round the circle twice
    cells = F.explode(F.sequence(first, last))
    return p.withColumn("__c", cells).withColumn("cell", F.pmod("__c", "__n")).drop("__n", "__w", "__c")


def _nearest(met: DataFrame, limit: float, inclusive: bool) -> DataFrame:
    """The nearest of the pairs of each position of the left catalogue."""
    met = met.where(F.abs(F.col("dec1") - F.col("dec2")) <= limit + _SLACK)
    dist = angular_distance(F.col("ra1"), F.col("dec1"), F.col("ra2"), F.col("dec2"))
    met = met.select("ra1", "dec1", "id2", dist.alias("dist"))
    met = met.where(F.col("dist") <= limit if inclusive else F.col("dist") < limit)
    best = met.groupBy("ra1", "dec1").agg(F.min(F.struct("dist", "id2")).alias("b"))
    return best.select("ra1", "dec1", "b.id2", "b.dist")


def _nearest_within(left: DataFrame, right: DataFrame, height: float, limit: float, inclusive: bool) -> DataFrame:
    met = _reaching(left, "ra1", "dec1", height).join(_placed(right, "ra2", "dec2", height), ["zone", "cell"])
    return _nearest(met, limit, inclusive)


def _finest(height: float) -> int:
    """The last level of the index whose cells are wider than the spacing of doubles."""
    return max(1, int((50 - math.log2(max(360 / height, 1.0))) // 2))


def _nested(points: DataFrame, ra: str, dec: str, height: float, level: Column) -> DataFrame:
    """Each point in its cell of a level; a cell is 4 x 4 cells of the next level, level 0 is the grid of ``_placed``."""
    fine, n = F.pow(F.lit(4.0), level), _cell_count(_zone(F.col(dec), height), height)
    # powers of two scale without rounding, so the levels nest exactly
    turn = F.floor(F.pmod(F.col(ra), F.lit(360.0)) / 360 * n * fine)
    return points.withColumn("zone", F.floor((F.col(dec) + 90) / F.lit(height) * fine)).withColumn(
        "cell", F.least(turn, (n * fine).cast("bigint") - 1))


def _crowded(points: DataFrame, height: float, cell_rows: int) -> DataFrame:
    """(level, zone, cell) of the cells of all levels with more than ``cell_rows`` points, counted in one job.

    Counts come from every ``cell_rows // 64``-th position by hash.  They steer
    only how full the leaves are; the index holds every position.
    """
    every = max(1, cell_rows // 64)
    some = points.where(F.pmod(F.xxhash64("ra2", "dec2"), F.lit(every)) == 0)
    levels = some.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(_finest(height) - 1))))
    counts = _nested(levels, "ra2", "dec2", height, F.col("level")).groupBy("level", "zone", "cell").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") * every > cell_rows).select("level", "zone", "cell")


def _leaves(points: DataFrame, crowd: DataFrame, height: float, depth: int) -> DataFrame:
    """Adds ``leaf``, the first level on which the cell of a point is not crowded."""
    out = points.withColumn("leaf", F.lit(0))
    for level in range(depth):
        full = crowd.where(F.col("level") == level).select("zone", "cell", F.lit(level + 1).alias("__deeper"))
        out = _nested(out, "ra2", "dec2", height, F.lit(level)).join(full, ["zone", "cell"], "left").withColumn(
            "leaf", F.coalesce("__deeper", "leaf")).drop("zone", "cell", "__deeper")
    return out


def _tree(leaves: DataFrame, height: float) -> DataFrame:
    """One row per cell of the index that holds points: their box, their number, one of them, and whether it is cut further."""
    above = _nested(leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("leaf")))), "ra2", "dec2", height, F.col("level"))
    turn = F.pmod(F.col("ra2"), F.lit(360.0))
    return above.groupBy("level", "zone", "cell").agg(
        F.min(turn).alias("ra_lo"), F.max(turn).alias("ra_hi"), F.min("dec2").alias("dec_lo"), F.max("dec2").alias("dec_hi"),
        F.count(F.lit(1)).alias("n"), F.min(F.struct("ra2", "dec2")).alias("one"), (F.max("leaf") > F.first("level")).alias("cut"))


def _box_distance() -> Column:
    """No point of the box is nearer to (ra1, dec1): the gap in declination, or the distance to the nearer side."""
    turn, dec = F.pmod(F.col("ra1"), F.lit(360.0)), F.col("dec1")
    gap = F.greatest(F.col("dec_lo") - dec, dec - F.col("dec_hi"), F.lit(0.0))
    off = F.least(F.pmod(F.col("ra_lo") - turn, F.lit(360.0)), F.pmod(turn - F.col("ra_hi"), F.lit(360.0)))
    side = F.when(off >= 90, 90 - F.abs(dec)).otherwise(F.degrees(F.asin(F.cos(F.radians(dec)) * F.sin(F.radians(off)))))
    side = F.when(turn.between(F.col("ra_lo"), F.col("ra_hi")), 0.0).otherwise(side)
    return F.greatest(gap, side) * (1 - 1e-7) - _SLACK


def _opened(left: DataFrame, tree: DataFrame, height: float, limit: float, depth: int) -> DataFrame:
    """(ra1, dec1, level, zone, cell, n): the leaves that may hold the nearest partner of a position.

    All positions go down the index together, a level a round.  A cell is
    entered only if its box is not farther than the nearest partner known so
    far; every cell that is met makes one of its points known.
    """
    mine = Window.partitionBy("ra1", "dec1")
    front = _reaching(left, "ra1", "dec1", height).select(
        "ra1", "dec1", F.lit(float(limit)).alias("bound"), F.col("zone").alias("__z"), F.col("cell").alias("__c"))
    found = None
    for level in range(depth + 1):
        up = (lambda x: F.col(x)) if level == 0 else (lambda x: F.shiftright(x, 2))
        here = tree.where(F.col("level") == level).withColumn("__z", up("zone")).withColumn("__c", up("cell"))
        met = front.join(here, ["__z", "__c"]).withColumn("near", _box_distance()).where("near <= bound")
        known = F.min(angular_distance(F.col("ra1"), F.col("dec1"), F.col("one.ra2"), F.col("one.dec2"))).over(mine)
        met = met.withColumn("bound", F.least("bound", known)).where("near <= bound").select(
            "ra1", "dec1", "bound", "near", "level", "zone", "cell", "n", "cut").checkpoint()
        part = met.where("not cut").drop("cut")
        found = part if found is None else found.unionByName(part)
        front = met.where("cut").select("ra1", "dec1", "bound", F.col("zone").alias("__z"), F.col("cell").alias("__c"))
    return found.withColumn("bound", F.min("bound").over(mine)).where("near <= bound").drop("bound", "near")


def _index(right: DataFrame, radius: float, cell_rows: int) -> tuple[DataFrame, int]:
    """``right`` with its leaf levels, and the deepest of them."""
    crowd = checked_broadcast(_crowded(right, radius, cell_rows))
    last = crowd.agg(F.max("level")).first()[0]
    depth = 0 if last is None else last + 1
    return (_leaves(right, crowd, radius, depth).checkpoint() if depth else right), depth


def crossmatch(cat1: DataFrame, cat2: DataFrame, radius: float, inclusive: bool = True, cell_rows: int = 1024) -> DataFrame:
    """For each (id, ra, dec) of ``cat1`` the closest row of ``cat2`` within ``radius`` degrees.

    Returns (id1, id2, dist); equal distances go to the smallest id2.  Rows
    without a partner are absent (see ``unmatched``).

    Both catalogues are put on a grid of declination zones and right-ascension
    cells at least ``radius`` high; only the rows of ``cat1`` are repeated, once
    per cell their search circle touches, and the pairs of a cell are reduced to
    the nearest one before anything is shuffled.  Copies of one position are
    matched once.  Where a cell of ``cat2`` is crowded it is the root of a
    hierarchical index of nested cells, and the rows of ``cat1`` go down to the
    leaves that the best partner so far leaves open; beside a crowded cell, too.
    """
    def clean(df, *names):
        out = df.toDF(*names)
        return out.where(F.col(names[1]).isNotNull() & F.col(names[2]).isNotNull()
                         & ~F.isnan(names[1]) & ~F.isnan(names[2]))

    ensure_checkpoint_dir(cat1.sparkSession)
    one = clean(cat1, "id1", "ra1", "dec1")
    left = one.select("ra1", "dec1").distinct()
    right = clean(cat2, "id2", "ra2", "dec2").groupBy("ra2", "dec2").agg(F.min("id2").alias("id2")).checkpoint()
    right, depth = _index(right, radius, cell_rows)
    if depth == 0:
        return one.join(_nearest_within(left, right, radius, radius, inclusive), ["ra1", "dec1"]).select("id1", "id2", "dist")
    opened = _opened(left, _tree(right, radius).checkpoint(), radius, radius, depth).drop("n")
    placed = _nested(right.withColumnRenamed("leaf", "level"), "ra2", "dec2", radius, F.col("level"))
    found = _nearest(opened.join(placed, ["level", "zone", "cell"]), radius, inclusive)
    return one.join(found, ["ra1", "dec1"]).select("id1", "id2", "dist")


def unmatched(cat1: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """Keys of ``cat1`` that have no match."""
    return cat1.select(F.col(key).alias("id1")).join(matches.select("id1"), "id1", "left_anti")
