"""Exact k nearest neighbours without pairing all rows.

Reference rows are assigned to the nearest of a few pivots.  From the pivot
distances alone each query row gets an upper bound of its k-th distance, so it
only visits the cells that can hold a neighbour (triangle inequality; the
pivot-based kNN join of Lu et al., 2012).  Cells are cut into pieces of bounded
size on both sides, and a piece sends at most k rows per query row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumentab.session import ensure_checkpoint_dir

c = F.col
_CELLS = 1 << 19  # distances that a task holds at a time


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances, one plane per dimension so that no precision is lost."""
    total = np.zeros((len(x), len(y)))
    for k in range(x.shape[1]):
        total += np.square(x[:, k][:, None] - y[:, k][None, :])
    return np.sqrt(total)


def _closest(x: np.ndarray, y: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of the ``m`` rows of ``y`` nearest to each row of ``x``; ties go to the earlier row.

    One matrix product gives all squared distances up to a known rounding error.
    Rows that may be among the nearest by it get their distance anew, from differences.
    """
    norm_x, norm_y = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    rough = norm_x[:, None] + norm_y[None, :] - 2 * (x @ y.T)
    if not np.isfinite(rough).all():
        d = _distances(x, y)
        near = d.argsort(axis=1, kind="stable")[:, :m]
        return near, np.take_along_axis(d, near, axis=1)
    error = 4 * (x.shape[1] + 8) * np.finfo(float).eps * (norm_x + norm_y.max())
    last = np.partition(rough, m - 1, axis=1)[:, m - 1]
    row, col = np.nonzero(rough <= (last + 2 * error)[:, None])
    total = np.zeros(len(row))
    for k in range(x.shape[1]):
        total += np.square(x[row, k] - y[col, k])
    d = np.sqrt(total)
    order = np.lexsort((col, d, row))
    first = np.searchsorted(row, np.arange(len(x)))  # row is sorted, before and after
    take = order[first[:, None] + np.arange(m)]
    return col[take], d[take]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 1))


def nearest(queries: DataFrame, reference: DataFrame, key: str, features: Sequence[str], label: str, k: int,
            pivots: int = 32, piece_rows: int = 8192) -> DataFrame:
    """(query, rank, neighbour, label, dist) for the k nearest reference rows of each query row.

    Equal distances rank by the neighbour's key.
    """
    spark = queries.sparkSession
    ensure_checkpoint_dir(spark)
    vec = F.array(*[c(f).cast("double") for f in features])
    ref = reference.select(c(key).cast("bigint").alias("id"), c(label).alias("label"), vec.alias("x"))
    ask = queries.select(c(key).cast("bigint").alias("id"), vec.alias("x")).checkpoint()
    # a bounded number of pivot rows, taken in the order of a key hash
    chosen = ref.orderBy(F.xxhash64("id"), "id").limit(pivots).select("x").toPandas()
    pivot = _matrix(chosen["x"])
    kind = reference.schema[label].dataType.simpleString()

    def to_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = _distances(_matrix(b["x"]), pivot)
                cell = d.argmin(axis=1)
                yield b.assign(cell=cell, d=d[np.arange(len(b)), cell])

    placed = ref.mapInPandas(to_cells, f"id bigint, label {kind}, x array<double>, cell int, d double").checkpoint()
    # at most one row per pivot comes back
    stat = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).toPandas()
    cells, n, lo, hi = (stat[s].to_numpy() for s in ("cell", "n", "lo", "hi"))
    need = min(k, int(n.sum()))

    def to_visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            d = _distances(_matrix(b["x"]), pivot[cells])
            far = d + hi
            order = far.argsort(axis=1)
            enough = (n[order].cumsum(axis=1) >= need).argmax(axis=1)
            bound = far[np.arange(len(b)), order[np.arange(len(b)), enough]] * (1 + 1e-9)
            visit = (d - hi <= bound[:, None]) & (lo - d <= bound[:, None])
            row, col = np.nonzero(visit)
            yield pd.DataFrame({"id": b["id"].to_numpy()[row], "x": b["x"].to_numpy()[row], "cell": cells[col]})

    visits = ask.mapInPandas(to_visits, "id bigint, x array<double>, cell int")
    asked = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = spark.createDataFrame(
        [(int(cell), -(-int(m) // piece_rows), -(-int(asked.get(cell, 0)) // piece_rows) or 1) for cell, m in zip(cells, n)],
        "cell int, ref_parts int, ask_parts int")

    def every(count):
        return F.explode(F.sequence(F.lit(0), c(count) - 1))

    left = visits.join(F.broadcast(parts), "cell").withColumn(
        "ap", F.pmod(F.xxhash64("id"), c("ask_parts")).cast("int")).withColumn("rp", every("ref_parts"))
    right = placed.join(F.broadcast(parts), "cell").withColumn(
        "rp", F.pmod(F.xxhash64("id"), c("ref_parts")).cast("int")).withColumn("ap", every("ask_parts"))

    def best(a: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        names = ["query", "neighbour", "label", "dist"]
        if not len(a) or not len(r):
            return pd.DataFrame({x: [] for x in names})
        r = r.sort_values("id")  # a stable sort by distance then ranks ties by key
        ids, labels, rx = r["id"].to_numpy(), r["label"].to_numpy(), _matrix(r["x"])
        m, out, step = min(k, len(r)), [], max(1, _CELLS // len(r))
        for first in range(0, len(a), step):
            part = a.iloc[first:first + step]
            near, d = _closest(_matrix(part["x"]), rx, m)
            out.append(pd.DataFrame({
                "query": np.repeat(part["id"].to_numpy(), m), "neighbour": ids[near].ravel(),
                "label": labels[near].ravel(), "dist": d.ravel()}))
        return pd.concat(out, ignore_index=True)

    spots = left.select("id", "x", "cell", "rp", "ap").groupBy("cell", "rp", "ap").cogroup(
        right.select("id", "label", "x", "cell", "rp", "ap").groupBy("cell", "rp", "ap"))
    found = spots.applyInPandas(best, f"query bigint, neighbour bigint, label {kind}, dist double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("dist", "neighbour"))
    return found.withColumn("rank", rank).where(c("rank") <= k)


def vote(ranked: DataFrame, k: int) -> DataFrame:
    """Majority label of the first k neighbours; a tie goes to the smallest label."""
    counts = ranked.where(c("rank") <= k).groupBy("query", "label").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("query").agg(F.min(F.struct((-c("n")).alias("m"), c("label").alias("label"))).alias("b"))
    return best.select("query", c("b.label").alias("prediction"))


def elbow(ranked: DataFrame, truth: DataFrame, key: str, label: str, k_max: int) -> DataFrame:
    """Error rate for every k up to ``k_max`` from one ranked list."""
    counted = (ranked.select("query", "label", F.explode(F.sequence(c("rank"), F.lit(k_max))).alias("k"))
               .groupBy("query", "k", "label").agg(F.count(F.lit(1)).alias("n")))
    best = counted.groupBy("query", "k").agg(F.min(F.struct((-c("n")).alias("m"), c("label").alias("label"))).alias("b"))
    actual = truth.select(c(key).alias("query"), c(label).alias("actual"))
    return best.join(actual, "query").groupBy("k").agg(F.avg((c("b.label") != c("actual")).cast("int")).alias("error_rate"))
