"""Products of the columns of a sparse matrix with many columns, made where they are used.

Columns are dealt to bins.  A row goes, as an array, once to each bin that holds one of
its columns; the task of a bin makes all products of its columns, adds them up and
uses them there, so no product crosses the network.  A row is sent at most as often as
it has entries.  There are as many bins as keep the products of a bin at ``_BIN`` on
average; a column of more is cut over several bins by the other column of the product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentab.session import ensure_checkpoint_dir

_BIN = 4_000_000  # products that a bin is meant to hold
_LEAST = 500_000  # and at least, where there are enough for all tasks
_PIECE = 4096  # entries of a row that travel in one array
_STEP = 1 << 20  # products that are made at a time

c = F.col


def packed_rows(cells: DataFrame) -> DataFrame:
    """(row, e, n, t): the entries (col, val, norm) of a row, its norm and its sum; ``norm`` is that of the column."""
    ensure_checkpoint_dir(cells.sparkSession)
    return cells.groupBy("row").agg(F.collect_list(F.struct("col", "val", "norm")).alias("e"),
                                    F.sqrt(F.sum(c("val") * c("val"))).alias("n"), F.sum("val").alias("t")).checkpoint()


def _bins(packed: DataFrame) -> tuple[int, dict[int, int], bool]:
    """Number of bins, the columns that are cut, with the number of their parts, and whether there are long rows."""
    met = packed.select(F.size("e").cast("bigint").alias("n"), F.explode("e.col").alias("col")).groupBy("col").agg(F.sum("n").alias("met"), F.max("n").alias("n"))
    total, most, longest = met.agg(F.sum("met"), F.max("met"), F.max("n")).first()
    total = int(total or 0)
    tasks = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    hot = {}
    if (most or 0) > 4 * _BIN:  # so many are fewer than a quarter of the bins
        hot = {r["col"]: int(r["met"]) // _BIN + 1 for r in met.where(c("met") > 4 * _BIN).collect()}
    return max(min(tasks, total // _LEAST + 1), total // _BIN + 1), hot, (longest or 0) > _PIECE


def _records(rows: DataFrame, chosen: str, n_bins: int, hot: dict[int, int], long_rows: bool) -> DataFrame:
    """``rows`` once for each bin of the columns in the array ``chosen``.

    ``only`` holds the columns that this copy is for where they are not all of the bin, and
    ``own`` their entries.  Long rows come in pieces.
    """
    bin_of = lambda x: F.pmod(x, F.lit(n_bins)).cast("int")
    is_hot = lambda x: x.isin(list(hot))
    plain = F.filter(chosen, lambda x: ~is_hot(x)) if hot else c(chosen)
    out = rows.withColumn("bin", F.explode(F.array_distinct(F.transform(plain, bin_of))))
    none = F.lit(None).cast(rows.schema[chosen].dataType)
    only = F.when(F.size("e") > _PIECE, F.filter(plain, lambda x: bin_of(x) == c("bin"))) if long_rows else none
    own = F.when(c("only").isNotNull(), F.filter("e", lambda x: F.array_contains("only", x["col"])))
    out = out.withColumn("only", only).withColumn("own", own if long_rows else F.lit(None).cast(rows.schema["e"].dataType))
    if hot:
        parts = F.create_map(*[F.lit(v) for item in hot.items() for v in item])
        cut = rows.withColumn("hot", F.explode(F.filter(chosen, is_hot))).withColumn("of", parts[c("hot")])
        cut = cut.withColumn("k", F.explode(F.sequence(F.lit(0), c("of") - 1)))
        cut = cut.withColumn("bin", F.pmod(F.xxhash64("hot", "k"), F.lit(n_bins)).cast("int")).withColumn("only", F.array("hot"))
        cut = cut.withColumn("own", own).withColumn("e", F.filter("e", lambda x: F.pmod(x["col"], c("of")) == c("k")))
        out = out.unionByName(cut.where(F.size("e") > 0).select(*out.columns))
    if not long_rows:
        return out
    first = F.sequence(F.lit(1), F.size("e"), F.lit(_PIECE))
    return out.withColumn("e", F.explode(F.transform(first, lambda i: F.slice("e", i, _PIECE))))


def _dealt(records: DataFrame, n_bins: int) -> DataFrame:
    return records.repartitionById(n_bins, "bin").sortWithinPartitions("bin", "kind")


def _first_columns(packed: DataFrame, n_bins: int, hot: dict[int, int], long_rows: bool) -> DataFrame:
    # rows without a name count for the products, and with no weight for the weighted ones
    weight = F.when(c("row").isNull(), 0.0).otherwise(1 / c("n"))
    unit = F.transform("e", lambda v: F.struct(v["col"].alias("col"), (v["val"] / v["norm"]).alias("x")))
    rows = _records(packed.select("row", weight.alias("w"), c("e.col").alias("chosen"), unit.alias("e")), "chosen", n_bins, hot, long_rows)
    return rows.select("bin", F.lit(0).alias("kind"), "row", "w", c("e.col").alias("cols"), c("e.x").alias("x"),
                       F.lit(None).cast("array<double>").alias("y"), c("own.col").alias("ocols"), c("own.x").alias("ox"))


def cosines(packed: DataFrame, n_cols: int) -> DataFrame:
    """(a, b, v): cosines of the columns a < b that share a row."""
    n_bins, hot, long_rows = _bins(packed)
    records = _dealt(_first_columns(packed, n_bins, hot, long_rows), n_bins)
    return records.mapInArrow(_worker(n_cols, n_bins, list(hot), True), "a bigint, b bigint, v double")


def wanted_sums(packed: DataFrame, n_cols: int, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sums at the cells (row, col) of ``wanted``, and (col, sv, norm), sv the sum of a column's cosines, its own included.

    The first is (row, col, s, g): over the entries b of the row, val times the
    cosine of col and b, and val / n times the product of both columns with each
    row divided by its norm; g lacks the factor norm of col.
    """
    n_bins, hot, long_rows = _bins(packed)
    asked = wanted.groupBy("row").agg(F.collect_list("col").alias("chosen"))
    both = F.transform("e", lambda v: F.struct(v["col"].alias("col"), v["val"].alias("x"), (v["val"] * v["norm"] / c("n")).alias("y")))
    rows = _records(packed.join(asked, "row").select("row", "chosen", both.alias("e")), "chosen", n_bins, hot, long_rows)
    asked = rows.select(
        "bin", F.lit(1).alias("kind"), "row", F.lit(0.0).alias("w"), c("e.col").alias("cols"), c("e.x").alias("x"), c("e.y").alias("y"),
        F.coalesce("only", "chosen").alias("ocols"), F.when(c("only").isNotNull(), F.array().cast("array<double>")).alias("ox"))
    records = _dealt(_first_columns(packed, n_bins, hot, long_rows).unionByName(asked), n_bins)
    kind = packed.schema["row"].dataType.simpleString()
    out = records.mapInArrow(_worker(n_cols, n_bins, list(hot), False), f"row {kind}, col bigint, sv double, s double, g double").checkpoint()
    sums = out.where(c("sv").isNull()).groupBy("row", "col").agg(F.sum("s").alias("s"), F.sum("g").alias("g"))
    norms = packed.select(F.explode("e").alias("e")).groupBy(c("e.col").alias("col")).agg(F.first("e.norm").alias("norm"))
    own = out.where(c("sv").isNotNull()).groupBy("col").agg(F.sum("sv").alias("sv")).join(norms, "col")
    return sums, own


def _worker(n_cols: int, n_bins: int, hot: list[int], upper: bool):
    """A mapInArrow function over the records of bins, the first columns of a bin before its wanted cells."""
    step, full, send = _STEP, _BIN, 1 << 17

    def flat(lists) -> np.ndarray:
        return lists.flatten().to_numpy(zero_copy_only=False)

    def lengths(lists) -> np.ndarray:
        return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)

    def steps(left_rec: np.ndarray, size: np.ndarray, start: np.ndarray):
        """(first, last, left, right): entries on the left meet all entries of their record, at most ``step`` at a time."""
        n = size[left_rec]
        edge = np.concatenate([[0], np.cumsum(n)])
        first = 0
        while first < len(n):
            last = max(first + 1, int(np.searchsorted(edge, edge[first] + step, "right")) - 1)
            left = np.repeat(np.arange(first, last), n[first:last])
            yield first, last, left, start[left_rec[left]] + np.arange(len(left)) - (edge[left] - edge[first])
            first = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = [np.empty(0, np.int64), np.empty(0), np.empty(0)]  # key, product, weighted product; sorted by key
        waiting, n_waiting, now = [], 0, None

        def add_up() -> None:
            nonlocal table, waiting, n_waiting
            if not n_waiting:
                return
            key, *values = (np.concatenate(x) for x in zip(*waiting, *([tuple(table)] if len(table[0]) else [])))
            order = np.argsort(key)
            key = key[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            table, waiting, n_waiting = [key[at], *(np.add.reduceat(v[order], at) for v in values)], [], 0

        def found() -> Iterator[pa.RecordBatch]:
            add_up()
            key, value = table[0], table[1]
            if upper:
                for k in range(0, len(key), send):
                    yield pa.RecordBatch.from_arrays([pa.array(key[k:k + send] // n_cols), pa.array(key[k:k + send] % n_cols), pa.array(value[k:k + send])], ["a", "b", "v"])
            elif len(key):
                first = key // n_cols
                at = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
                none = pa.nulls(len(at), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.nulls(len(at), row_type), pa.array(first[at]), pa.array(np.add.reduceat(value, at)), none, none], ["row", "col", "sv", "s", "g"])

        for whole in batches:
            if not whole.num_rows:
                continue
            row_type = whole.schema.field("row").type
            place = whole.column("bin").to_numpy().astype(np.int64) * 2 + whole.column("kind").to_numpy()
            for part in np.split(np.arange(len(place)), np.flatnonzero(np.diff(place)) + 1):
                batch, this, kind = whole.slice(part[0], len(part)), int(place[part[0]] // 2), int(place[part[0]] % 2)
                if this != now:
                    if now is not None:
                        yield from found()
                    table, now = [np.empty(0, np.int64), np.empty(0), np.empty(0)][:2 if upper else 3], this
                size = lengths(batch.column("cols"))
                start = np.cumsum(size) - size
                cols, x = flat(batch.column("cols")), flat(batch.column("x"))
                given = batch.column("ox").is_valid().to_numpy(zero_copy_only=False)
                ocols, orec = flat(batch.column("ocols")), np.repeat(np.arange(len(size)), lengths(batch.column("ocols")))
                if kind == 0:
                    rec = np.repeat(np.arange(len(size)), size)
                    mine = (cols % n_bins == this) & ~given[rec]
                    if hot:
                        mine &= ~np.isin(cols, hot)
                    ox = np.concatenate([x[mine], flat(batch.column("ox"))])
                    ocols, orec = np.concatenate([cols[mine], ocols]), np.concatenate([rec[mine], orec])
                    w = batch.column("w").to_numpy(zero_copy_only=False)
                    for _, _, left, right in steps(orec, size, start):
                        if upper:
                            kept = ocols[left] < cols[right]
                            left, right = left[kept], right[kept]
                        value = ox[left] * x[right]
                        made = [ocols[left] * n_cols + cols[right], value]
                        waiting.append(made if upper else [*made, value * w[orec[left]]])
                        n_waiting += len(value)
                        if n_waiting > max(full, len(table[0])):
                            add_up()
                    continue
                add_up()
                mine = ((ocols % n_bins == this) & ~np.isin(ocols, hot)) | given[orec]
                ocols, orec, y = ocols[mine], orec[mine], flat(batch.column("y"))
                for first, last, left, right in steps(orec, size, start):
                    key = ocols[left] * n_cols + cols[right]
                    at = np.minimum(np.searchsorted(table[0], key), len(table[0]) - 1)
                    hit, at_left = table[0][at] == key, np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
                    s, g = (np.add.reduceat(np.where(hit, v[at] * t[right], 0.0), at_left) for v, t in ((table[1], x), (table[2], y)))
                    yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(orec[first:last])), pa.array(ocols[first:last]),
                                                      pa.nulls(last - first, pa.float64()), pa.array(s), pa.array(g)], ["row", "col", "sv", "s", "g"])
        if now is not None:
            yield from found()

    return run
