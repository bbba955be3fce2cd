"""Products of the columns of a sparse matrix with many columns, made where two blocks of columns meet.

Columns are dealt to blocks by hash, and the entries of a block are packed once, compressed, in one
record of a written table.  Pairs of blocks meet in a Cartesian product, which reads that
table again for each block and shuffles nothing; the task of a pair makes the products of its
columns a slice at a time and uses them there.  What is written is the matrix, twice, whatever the number
of products; what is read grows with the number of blocks, so beyond ``_MOST_BLOCKS``, or where
one block outgrows the others, ``lay_out`` gives nothing and ``stripes`` is the way to go.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumentab.session import ensure_checkpoint_dir, scratch_path

_ENTRIES = 1_000_000  # entries of a block, on average
_LEAST = 50_000  # and at least, where there are enough for all tasks
_CROWDED = 16_000_000  # entries that a block may hold
_MOST_BLOCKS = 256
_STEP = 1 << 20  # products that are made at a time
_TABLE = 1 << 23  # rows that are looked up in an array of their own

c = F.col


class Grid(NamedTuple):
    blocks: DataFrame  # one record for each block, each in a partition of its own
    n_blocks: int
    n_cols: int
    n_rows: int
    total: float  # of the sums of all rows


def packed_rows(cells: DataFrame) -> DataFrame:
    """(rid, row, e, w, n, t), written: the entries (col, val) of a row, its cells that are ``asked`` for, its norm and its sum.

    ``cells`` holds (row, col, val, asked); a cell that is asked for is no entry.  Rows without entries are left out.
    """
    ensure_checkpoint_dir(cells.sparkSession)
    learned, cell = F.when(~c("asked"), c("val")), F.struct("col", "val")
    rows = cells.groupBy("row").agg(F.collect_list(F.when(~c("asked"), cell)).alias("e"), F.collect_list(F.when(c("asked"), cell)).alias("w"),
                                    F.sqrt(F.sum(learned * learned)).alias("n"), F.sum(learned).alias("t"))
    rows = rows.where(F.size("e") > 0).select(F.monotonically_increasing_id().alias("rid"), "*")
    path = scratch_path(cells.sparkSession, "rows")
    rows.write.parquet(path)
    return cells.sparkSession.read.schema(rows.schema).parquet(path)


def entries(packed: DataFrame) -> DataFrame:
    """(row, col, val) of all entries."""
    return packed.select("row", F.explode("e").alias("e")).select("row", "e.col", "e.val")


def lay_out(packed: DataFrame) -> Grid | None:
    """The blocks of the matrix of ``packed_rows``, or nothing where they were too many or one of them too large."""
    spark = packed.sparkSession
    ensure_checkpoint_dir(spark)
    parts = packed.groupBy(F.shiftright("rid", 33).alias("p")).agg(
        F.max("rid").alias("last"), F.sum(F.size("e")).alias("n"), F.count(F.lit(1)).alias("rows"), F.sum("t").alias("t")).orderBy("p").collect()
    n_entries, n_rows = sum(x["n"] for x in parts), sum(x["rows"] for x in parts)
    cores = spark.sparkContext.defaultParallelism
    n_blocks = max(-(-n_entries // _ENTRIES), min(cores, -(-n_entries // _LEAST)), 1)
    if n_blocks > _MOST_BLOCKS:
        return None
    dealt = lambda x: F.transform(x, lambda v: F.pmod(F.xxhash64(v), F.lit(n_blocks)).cast("int"))
    if n_entries > _CROWDED:
        met = packed.select(F.explode(dealt("e.col")).alias("block")).groupBy("block").count()
        if met.agg(F.max("count")).first()[0] > _CROWDED:
            return None
    # numbers of rows without gaps: those of a partition of the written table follow each other
    sizes = [x["last"] - (x["p"] << 33) + 1 for x in parts]
    starts = np.array([x["p"] for x in parts], np.int64), np.cumsum([0, *sizes])[:-1].astype(np.int64)
    row, col = packed.schema["row"].dataType.simpleString(), packed.schema["e"].dataType.elementType["col"].dataType.simpleString()
    sent = packed.select("rid", "row", "n", "t", c("e.col").alias("cols"), c("e.val").alias("vals"), dealt("e.col").alias("blks"),
                         c("w.col").alias("wcols"), c("w.val").alias("wvals"), dealt("w.col").alias("wblks"))
    sent = sent.mapInArrow(_dealer(n_blocks, starts), f"block int, rows binary, size binary, n binary, t binary, cols array<{col}>, vals binary, "
                                                      f"wrow array<{row}>, wcols array<{col}>, wrows binary, wt binary, wvals binary")
    blocks = sent.repartitionById(n_blocks, "block").mapInArrow(
        _packer(), f"block int, n_cols int, names array<{col}>, rows binary, size binary, n binary, col binary, val binary, norm binary, sb binary, gb binary, "
                   f"xb binary, named binary, wrow array<{row}>, wrows binary, wcol binary, wt binary, wval binary").checkpoint()
    n_cols = blocks.agg(F.sum("n_cols")).first()[0] or 0
    return Grid(blocks, n_blocks, int(n_cols), sum(sizes), float(sum(x["t"] for x in parts)))


def cosines(grid: Grid) -> DataFrame:
    """(a, b, v): cosines of the columns a < b that share a row."""
    col = grid.blocks.schema["names"].dataType.elementType.simpleString()
    i, j, half = c("block"), c("r_block"), F.lit(grid.n_blocks)
    ahead = F.pmod(j - i, half)  # each pair of blocks once, and as many for each block
    met = (2 * ahead < half) | ((2 * ahead == half) & (i < j))
    left = grid.blocks.select("block", *_SIDE)
    return _pairs(grid, left, met, ["names"]).mapInArrow(_cosines(grid.n_rows), f"a {col}, b {col}, v double")


def wanted_sums(grid: Grid) -> DataFrame:
    """(row, col, val, t, s, sv, x, g, us, named): sums at the cells that were asked for.

    ``t`` and ``x`` are the sums of the row and of the column, ``s`` the sum over the entries b of the row of val times the cosine of col
    and b, ``sv`` the sum of all cosines of the column, its own included, ``named`` whether a row with a name holds the column.
    With u the entries of a row divided by its norm: ``us`` sums u_b times the sum of column b of u, and ``g`` sums u_b times (the product
    of val of col and u of b over all rows, less the sum of column b of u t / number of columns).
    """
    schema = grid.blocks.schema
    row, col = (schema[x].dataType.elementType.simpleString() for x in ("wrow", "names"))
    left = grid.blocks.select("block", *_SIDE, "xb", "named", "wrow", "wrows", "wcol", "wt", "wval")
    parts = _pairs(grid, left, F.lit(True), ["sb", "gb"]).mapInArrow(
        _sums(grid.n_rows, grid.n_cols), f"row {row}, col {col}, val double, t double, x double, named boolean, s double, sv double, g double, us double")
    # a task that met all blocks for one of them sends its sums once
    return parts.groupBy("row", "col").agg(*[F.first(x).alias(x) for x in ("val", "t", "x", "named")], *[F.sum(x).alias(x) for x in ("s", "sv", "g", "us")])


_SIDE = ["n_cols", "names", "rows", "size", "n", "col", "val", "norm"]


def _pairs(grid: Grid, left: DataFrame, met, more: list[str]) -> DataFrame:
    """The blocks of ``left`` with each block that they meet, those of a block one after the other."""
    right = grid.blocks.select("block", *[x for x in _SIDE if x != "names"], *more)
    right = right.toDF(*[f"r_{x}" for x in right.columns])
    return left.join(right.hint("shuffle_replicate_nl"), met).coalesce(grid.n_blocks)


def _press():
    """Functions that make an array bytes and bytes an array."""
    def small(x: np.ndarray, kind) -> bytes:
        x = np.ascontiguousarray(x, kind)
        return np.int64(x.size).tobytes() + (pa.compress(x.tobytes(), codec="zstd", asbytes=True) if x.size else b"")

    def large(z, kind) -> np.ndarray:
        z = pa.py_buffer(z) if isinstance(z, bytes) else z.as_buffer()
        n = int(np.frombuffer(z, np.int64, 1)[0])
        return np.frombuffer(pa.decompress(z.slice(8), n * np.dtype(kind).itemsize, codec="zstd"), kind) if n else np.empty(0, kind)

    return small, large


def _dealer(n_blocks: int, starts: tuple[np.ndarray, np.ndarray]):
    """Rows to one record for each block, of what a batch of rows holds of it."""
    small, _ = _press()
    parts, first = starts

    def listed(values: pa.Array, edge: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rid = b["rid"].to_numpy()
            number = first[np.searchsorted(parts, rid >> 33)] + (rid & ((1 << 33) - 1))
            norm, t = b["n"].to_numpy(zero_copy_only=False), b["t"].to_numpy(zero_copy_only=False)
            norm = np.where(b["row"].is_null().to_numpy(zero_copy_only=False), np.inf, norm)  # a row without a name has no weight

            def by_block(cols: str, vals: str, blks: str):
                size = pc.list_value_length(b[cols]).to_numpy(zero_copy_only=False)
                rec, blk = np.repeat(np.arange(len(size)), size), b[blks].flatten().to_numpy(zero_copy_only=False)
                order = np.argsort(blk, kind="stable")
                edge = np.searchsorted(blk[order], np.arange(n_blocks + 1))
                return rec[order], b[cols].flatten().take(pa.array(order)), b[vals].flatten().to_numpy(zero_copy_only=False)[order], edge

            rec, cols, vals, edge = by_block("cols", "vals", "blks")
            wrec, wcols, wvals, wedge = by_block("wcols", "wvals", "wblks")
            out = {x: [] for x in ("rows", "size", "n", "t", "vals", "wrows", "wt", "wvals")}
            for k in range(n_blocks):
                of, wof = slice(edge[k], edge[k + 1]), slice(wedge[k], wedge[k + 1])
                rows, size = np.unique(rec[of], return_counts=True)
                for name, x, kind in (("rows", number[rows], np.int64), ("size", size, np.int32), ("n", norm[rows], float), ("t", t[rows], float), ("vals", vals[of], float),
                                      ("wrows", number[wrec[wof]], np.int64), ("wt", t[wrec[wof]], float), ("wvals", wvals[wof], float)):
                    out[name].append(small(x, kind))
            put = {x: pa.array(v, pa.binary()) for x, v in out.items()}
            yield pa.RecordBatch.from_pydict({
                "block": pa.array(np.arange(n_blocks, dtype=np.int32)), "rows": put["rows"], "size": put["size"], "n": put["n"], "t": put["t"],
                "cols": listed(cols, edge), "vals": put["vals"], "wrow": listed(b["row"].take(pa.array(wrec)), wedge), "wcols": listed(wcols, wedge),
                "wrows": put["wrows"], "wt": put["wt"], "wvals": put["wvals"]})

    return run


def _packer():
    """The records of a block to one, its entries in the order of rows and columns, its columns in the order of their names."""
    small, large = _press()

    def one(block: int, held: list[dict]) -> pa.RecordBatch:
        def all_of(name: str, kind) -> np.ndarray:
            return np.concatenate([large(x[name], kind) for x in held])

        given = pa.concat_arrays([x["cols"].values for x in held]).dictionary_encode()
        order = pc.sort_indices(given.dictionary).to_numpy()
        names, rank = given.dictionary.take(pa.array(order)), np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        col, val = rank[given.indices.to_numpy()], all_of("vals", float)
        rows, size, n, t = all_of("rows", np.int64), all_of("size", np.int32), all_of("n", float), all_of("t", float)
        rec = np.repeat(np.arange(len(rows)), size)
        sums = lambda x: np.bincount(col, x, len(names)) if len(names) else np.empty(0)
        u, known = val / n[rec], np.isfinite(n[rec])
        columns = {"norm": np.sqrt(sums(val * val)), "sb": sums(u), "gb": sums(u * t[rec]), "xb": sums(np.where(known, val, 0.0))}
        named = sums(known.astype(float)) > 0
        inner = np.lexsort((col, rows[rec]))
        by_row = np.argsort(rows)
        wcol = pc.index_in(pa.concat_arrays([x["wcols"].values for x in held]), value_set=names)
        met = np.flatnonzero(wcol.is_valid().to_numpy(zero_copy_only=False))
        wcol = pc.fill_null(wcol, 0).to_numpy()[met]
        met = met[np.argsort(wcol, kind="stable")]
        wrow = pa.concat_arrays([x["wrow"].values for x in held]).take(pa.array(met))
        put = {"rows": (rows[by_row], np.int64), "size": (size[by_row], np.int32), "n": (n[by_row], float), "col": (col[inner], np.int32), "val": (val[inner], float),
               **{k: (v, float) for k, v in columns.items()}, "named": (named, bool)}
        asked = {"wrows": (all_of("wrows", np.int64)[met], np.int64), "wcol": (np.sort(wcol), np.int32), "wt": (all_of("wt", float)[met], float), "wval": (all_of("wvals", float)[met], float)}
        listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        binary = lambda x: {k: pa.array([small(*v)], pa.binary()) for k, v in x.items()}
        return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "n_cols": pa.array([len(names)], pa.int32()), "names": listed(names),
                                           **binary(put), "wrow": listed(wrow), **binary(asked)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}
        for b in batches:
            for k, block in enumerate(b["block"].to_pylist()):
                held.setdefault(block, []).append({x: b[x][k] for x in b.schema.names})
        for block in sorted(held):
            yield one(block, held.pop(block))

    return run


def _products(n_rows: int):
    """Functions that read the two sides of a pair of blocks, and that make the products of their columns."""
    _, large = _press()
    step, table = _STEP, _TABLE

    def right_side(b: pa.RecordBatch, k: int) -> dict:
        """Entries in the order of rows, with the place where the entries of each row begin."""
        x = {name: large(b[f"r_{name}"][k], kind) for name, kind in (("rows", np.int64), ("size", np.int32), ("n", float), ("col", np.int32), ("val", float), ("norm", float))}
        x["size"] = x["size"].astype(np.int64)
        x["start"] = np.cumsum(x["size"]) - x["size"]
        x["x"], x["n_cols"] = x["val"] / x["norm"][x["col"]], b["r_n_cols"][k].as_py()
        if n_rows <= table:
            place = np.full(n_rows, -1, np.int32)
            place[x["rows"]] = np.arange(len(x["rows"]), dtype=np.int32)
            x["place"] = lambda rows: place[rows]
        else:
            def place_of(rows: np.ndarray) -> np.ndarray:
                at = np.minimum(np.searchsorted(x["rows"], rows), len(x["rows"]) - 1)
                return np.where(x["rows"][at] == rows, at, -1)

            x["place"] = place_of
        return x

    def left_side(b: pa.RecordBatch, k: int) -> dict:
        """Entries in the order of columns."""
        rows, size, n, col, val, norm = (large(b[name][k], kind) for name, kind in (
            ("rows", np.int64), ("size", np.int32), ("n", float), ("col", np.int32), ("val", float), ("norm", float)))
        rec = np.repeat(np.arange(len(rows)), size)
        order = np.argsort(col, kind="stable")
        rec, col, val = rec[order], col[order].astype(np.int64), val[order]
        return {"names": b["names"][k].values, "n_cols": b["n_cols"][k].as_py(), "rows": rows[rec], "col": col, "x": val / norm[col], "y": val / n[rec]}

    def added(left: dict, right: dict, weighted: bool) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """(last, key, sums) slice by slice: all products of the left columns up to ``last``, key = left column x number of right columns + right column."""
        at = right["place"](left["rows"])
        met = np.flatnonzero(at >= 0)
        at, col, x = at[met], left["col"][met], left["x"][met]
        y = left["y"][met] if weighted else None
        size, start, n_cols = right["size"][at], right["start"][at], right["n_cols"]
        edge = np.concatenate([[0], np.cumsum(size)])
        rest, first = None, 0  # what the last column of a slice has so far, as it may go on in the next one
        while first < len(col):
            last = max(first + 1, int(np.searchsorted(edge, edge[first] + step, "right")) - 1)
            n = size[first:last]
            i = np.repeat(np.arange(first, last), n)
            j = np.arange(edge[first], edge[last]) + np.repeat(start[first:last] - edge[first:last], n)
            key = col[i] * n_cols + right["col"][j]
            sums = [x[i] * right["x"][j], *([y[i] * right["val"][j]] if weighted else [])]
            if rest is not None:
                key, sums = np.concatenate([rest[0], key]), [np.concatenate(p) for p in zip(rest[1], sums)]
            order = np.argsort(key)
            key = key[order]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            key, sums = key[new], [np.add.reduceat(p[order], new) for p in sums]
            rest, done, upto = None, len(key), int(col[last - 1])
            if last < len(col) and col[last] == upto:
                done = int(np.searchsorted(key, upto * n_cols))
                rest, upto = (key[done:], [p[done:] for p in sums]), upto - 1
            yield upto, key[:done], [p[:done] for p in sums]
            first = last

    return left_side, right_side, added


def _cosines(n_rows: int):
    left_side, right_side, added = _products(n_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left = None, None
        for b in batches:
            for k, (i, j) in enumerate(zip(b["block"].to_pylist(), b["r_block"].to_pylist())):
                if i != now:
                    now, left = i, left_side(b, k)
                right, other = right_side(b, k), b["r_names"][k].values
                both = pa.concat_arrays([left["names"], other])
                rank = np.empty(len(both), np.int64)
                rank[pc.sort_indices(both).to_numpy()] = np.arange(len(both))
                n = left["n_cols"]
                for _, key, (v,) in added(left, right, False):
                    a, o = key // right["n_cols"], key % right["n_cols"]
                    if i == j:
                        kept = a < o
                        a, o, v = a[kept], o[kept], v[kept]
                    o = o + n
                    less = rank[a] < rank[o]
                    ends = [both.take(pa.array(np.where(less, *pair))) for pair in ((a, o), (o, a))]
                    for at in range(0, len(v), 1 << 17):
                        yield pa.RecordBatch.from_arrays([*(x[at : at + (1 << 17)] for x in ends), pa.array(v[at : at + (1 << 17)])], ["a", "b", "v"])

    return run


def _sums(n_rows: int, n_cols: int):
    left_side, right_side, added = _products(n_rows)
    _, large = _press()
    step = _STEP

    def add_asked(out: dict, right: dict, u: np.ndarray, at: np.ndarray, cells: np.ndarray, key: np.ndarray, sums: list[np.ndarray]) -> None:
        """Adds to the sums of the cells the products of their columns with the entries of their rows."""
        size = right["size"][at[cells]]
        edge = np.concatenate([[0], np.cumsum(size)])
        first = 0
        while first < len(cells):
            last = max(first + 1, int(np.searchsorted(edge, edge[first] + step, "right")) - 1)
            n, some = size[first:last], cells[first:last]
            i = np.repeat(np.arange(last - first), n)
            j = np.arange(edge[first], edge[last]) + np.repeat(right["start"][at[some]] - edge[first:last], n)
            wanted = out["col"][some][i] * right["n_cols"] + right["col"][j]
            place = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            hit = np.flatnonzero(key[place] == wanted)
            i, j, place = i[hit], j[hit], place[hit]
            out["s"][some] += np.bincount(i, sums[0][place] * right["val"][j], len(some))
            out["g"][some] += np.bincount(i, sums[1][place] * u[j], len(some))
            first = last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left, held = None, None, {}
        for b in batches:
            for k, i in enumerate(b["block"].to_pylist()):
                if i not in held:
                    asked = {x: large(b[y][k], kind) for x, y, kind in (("rows", "wrows", np.int64), ("col", "wcol", np.int32), ("t", "wt", float), ("val", "wval", float))}
                    asked["col"] = asked["col"].astype(np.int64)
                    held[i] = asked | {"row": b["wrow"][k].values, "names": b["names"][k].values, "x": large(b["xb"][k], float), "named": large(b["named"][k], bool),
                                       "sv": np.zeros(b["n_cols"][k].as_py()), **{x: np.zeros(len(asked["t"])) for x in ("s", "g", "us")}}
                out = held[i]
                if not len(out["t"]):
                    continue
                if i != now:
                    now, left = i, left_side(b, k)
                right = right_side(b, k)
                if not len(right["rows"]):
                    continue
                u = right["val"] / np.repeat(right["n"], right["size"])
                own, given = (np.add.reduceat(u * large(b[f"r_{x}"][k], float)[right["col"]], right["start"]) for x in ("sb", "gb"))
                at = right["place"](out["rows"])
                met = np.flatnonzero(at >= 0)
                out["us"][met] += own[at[met]]
                out["g"][met] -= given[at[met]] / n_cols
                done = 0
                for upto, key, sums in added(left, right, True):
                    if not len(key):
                        continue
                    out["sv"] += np.bincount(key // right["n_cols"], sums[0], len(out["sv"]))
                    end = int(np.searchsorted(out["col"][met], upto, "right"))
                    add_asked(out, right, u, at, met[done:end], key, sums)
                    done = end
        for out in held.values():
            of = out["col"]
            found = {"row": out["row"], "col": out["names"].take(pa.array(of)), **{x: pa.array(v) for x, v in (
                ("val", out["val"]), ("t", out["t"]), ("x", out["x"][of]), ("named", out["named"][of]), ("s", out["s"]), ("sv", out["sv"][of]), ("g", out["g"]), ("us", out["us"]))}}
            for first in range(0, len(of), 1 << 17):
                yield pa.RecordBatch.from_pydict({x: v[first : first + (1 << 17)] for x, v in found.items()})

    return run
