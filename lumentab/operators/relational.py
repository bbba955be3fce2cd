"""Selection, projection and labelling operators with explicit NULL rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentab.operators.ranking import with_row_number


def mask_elementwise(df: DataFrame, columns: Sequence[str], keep) -> DataFrame:
    """Keep the shape; cells for which ``keep(col)`` is not true become NULL."""
    return df.withColumns({c: F.when(keep(F.col(c)), F.col(c)) for c in columns})


def rows_by_label(df: DataFrame, key: str, labels: Sequence, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows whose key is one of ``labels``, optionally a column subset."""
    picked = df.where(F.col(key).isin(list(labels)))
    return picked.select(*columns) if columns else picked


def rows_by_position(df: DataFrame, order_by: str, start: int, stop: int, out: str = "pos") -> DataFrame:
    """0-based half-open slice of rows in ``order_by`` order (a unique key)."""
    numbered = with_row_number(df, order_by, out=out)
    return (
        numbered.withColumn(out, F.col(out) - 1)
        .where((F.col(out) >= start) & (F.col(out) < stop))
    )


def reset_index(df: DataFrame, order_by: str, tie: str | None = None, out: str = "index") -> DataFrame:
    """Add a 0-based position in the order of ``order_by`` and ``tie``, which together are unique."""
    return with_row_number(df, order_by, tie=tie, out=out).withColumn(out, F.col(out) - 1)


def cross_section(df: DataFrame, level: str, key) -> DataFrame:
    """Rows at one value of a key level; the level column is dropped."""
    return df.where(F.col(level) == F.lit(key)).drop(level)


def drop_label(df: DataFrame, key: str, label) -> DataFrame:
    """All rows but those with the label; rows with a NULL label stay."""
    return df.where(~F.col(key).eqNullSafe(F.lit(label)))


def date_slice(df: DataFrame, column: str, first: str, last: str) -> DataFrame:
    """Rows of the closed date interval; a plain range, so it reaches the scan."""
    return df.where((F.col(column) >= F.lit(first).cast("date"))
                    & (F.col(column) < F.date_add(F.lit(last).cast("date"), 1)))


def map_codes(column: Column, codes: Mapping) -> Column:
    """Look a value up in a small fixed mapping; unmapped values become NULL."""
    pairs = [F.lit(x) for kv in codes.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), column)


def dummies(df: DataFrame, column: str, categories: Sequence | None = None,
            drop_first: bool = True, prefix: str | None = None, limit: int = 10_000) -> DataFrame:
    """One 0/1 column per category in sort order, by default without the first.

    Without ``categories`` they are found by one distinct job.  One column per
    category makes sense only for a bounded domain, hence the checked limit.
    """
    if categories is None:
        found = df.where(F.col(column).isNotNull()).select(column).distinct().limit(limit + 1).collect()
        if len(found) > limit:
            raise ValueError(f"{column} has more than {limit} categories; stay in long form")
        categories = sorted(r[0] for r in found)
    kept = list(categories)[1:] if drop_first else list(categories)
    prefix = prefix or ""
    return df.withColumns({
        f"{prefix}{c}": F.when(F.col(column) == c, 1).otherwise(0) for c in kept
    })


def recode(column: Column, true_value) -> Column:
    """1 where the column equals ``true_value``, else 0 (NULL counts as other)."""
    return F.when(column == F.lit(true_value), 1).otherwise(0)


def wrap_degrees(angle: Column) -> Column:
    """Map an angle to (-180, 180]."""
    turned = F.pmod(angle, F.lit(360.0))
    return F.when(turned > 180, turned - 360).otherwise(turned)


def threshold_labels(value: Column, steps: Sequence[tuple[float, str]], otherwise: str,
                     flag: Column | None = None, allowance: float = 0.0) -> Column:
    """``if value > t: label`` in descending order; a set flag lowers the value first."""
    v = value if flag is None else value - F.when(flag, F.lit(allowance)).otherwise(F.lit(0.0))
    chain = None
    for limit, label in steps:
        chain = F.when(v > limit, label) if chain is None else chain.when(v > limit, label)
    return chain.otherwise(otherwise)


def long_matrix(df: DataFrame, row: str, columns: Sequence[Column]) -> DataFrame:
    """Turn ``columns`` of each row into rows (i, j, v), j counted from 0."""
    cells = F.posexplode(F.array(*columns))
    return df.select(F.col(row).alias("i"), cells.alias("j", "v"))


def submatrix(cells: DataFrame, rows: tuple[int, int | None], cols: tuple[int, int | None]) -> DataFrame:
    """Half-open row and column ranges of a long matrix (i, j, v); an end of None is the matrix's own."""
    inside = (F.col("i") >= rows[0]) & (F.col("j") >= cols[0])
    for name, end in (("i", rows[1]), ("j", cols[1])):
        inside = inside if end is None else inside & (F.col(name) < end)
    return cells.where(inside)


def pick_rows(cells: DataFrame, wanted: Sequence[int]) -> DataFrame:
    """Rows of a long matrix in the requested order, with their new position."""
    position = F.array_position(F.array(*[F.lit(w) for w in wanted]), F.col("i").cast("int")) - 1
    return cells.where(F.col("i").isin(list(wanted))).withColumn("pos", position)
