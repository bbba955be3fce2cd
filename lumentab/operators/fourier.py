"""Discrete Fourier transform of series of any length, N log N and without long groups.

A transform of length M = m1 x m2 is m2 short transforms of length m1, a
twist of each cell, and m1 transforms of length m2 (the four-step form of Bailey,
1990).  Lines are dealt to groups in blocks, so no task holds more than
``most`` cells or one line of about the square root of M, however long a series is.
Lengths that are no power of two, primes included, are written as a convolution
with a chirp (Bluestein, 1970), whose three transforms have one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: cells of a group, unless one line is longer
CELLS = 1 << 16


def _block(length: str, most: int):
    """Number of the block of lines of ``length`` cells that ``line`` falls into."""
    return F.expr(f"line div greatest(1L, {most}L div {length})")


# a transform of 2^p cells has 2^(p div 2) rows and 2^(p - p div 2) columns
_ROWS = "shiftleft(1L, cast(p div 2 as int))"
_COLUMNS = "shiftleft(1L, cast(p - p div 2 as int))"


def _lines(block: int, length: int, count: int, most: int) -> tuple[int, int]:
    """First line of a block and how many it has."""
    each = max(1, most // length)
    return block * each, min(each, count - block * each)


def _dense(pdf: pd.DataFrame, first: int, lines: int, length: int, re: str = "re", im: str = "im") -> np.ndarray:
    """Cells as a matrix of lines; what is absent is zero."""
    out = np.zeros((lines, length), complex)
    some = pdf[pdf["re"].notna()]
    out[some["line"].to_numpy(np.int64) - first, some["pos"].to_numpy(np.int64)] = some[re].to_numpy(float) + 1j * some[im].to_numpy(float)
    return out


def _cells(key, columns: dict) -> pd.DataFrame:
    size = len(next(iter(columns.values())))
    return pd.DataFrame({"series": pd.Series([key[0]] * size, dtype=object), "n": key[1], "p": key[2], **columns})


def _column_step(chirp: bool, most: int):
    """Transforms along the columns of the matrix, then the twist.

    With ``chirp`` the filter of the convolution is transformed beside the cells;
    its values follow from their place, so they are never rows before.
    """
    def step(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n, p, block = int(key[1]), int(key[2]), int(key[3])
        m1, m2 = 1 << p // 2, 1 << p - p // 2
        first, lines = _lines(block, m1, m2, most)
        line = np.arange(first, first + lines)
        twist = np.exp(-2j * np.pi * np.outer(line, np.arange(m1)) / (m1 * m2))
        a = np.fft.fft(_dense(pdf, first, lines, m1), axis=1) * twist
        out = {"line": np.tile(np.arange(m1), lines), "pos": np.repeat(line, m1), "re": a.real.ravel(), "im": a.imag.ravel()}
        if chirp:
            place = np.arange(m1)[None, :] * m2 + line[:, None]
            away = np.minimum(place, m1 * m2 - place)
            b = np.where(away < n, np.exp(1j * np.pi * (away * away % (2 * n)) / n), 0)
            b = np.fft.fft(b, axis=1) * twist
            out |= {"bre": b.real.ravel(), "bim": b.imag.ravel()}
        return _cells(key, out)

    return step


def _row_step(chirp: bool, most: int):
    """Transforms along the rows; with ``chirp`` the conjugate product of both, else the absolute value."""
    def step(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p, block = int(key[2]), int(key[3])
        m1, m2 = 1 << p // 2, 1 << p - p // 2
        first, lines = _lines(block, m2, m1, most)
        k = (np.arange(first, first + lines)[:, None] + m1 * np.arange(m2)[None, :]).ravel()
        a = np.fft.fft(_dense(pdf, first, lines, m2), axis=1).ravel()
        if not chirp:
            return _cells(key, {"k": k, "size": np.abs(a) / (m1 * m2)})
        z = np.conj(a * np.fft.fft(_dense(pdf, first, lines, m2, "bre", "bim"), axis=1).ravel())
        return _cells(key, {"line": k % m2, "pos": k // m2, "re": z.real, "im": z.imag})

    return step


def amplitudes(cells: DataFrame, most: int = CELLS) -> DataFrame:
    """(series, n, k, size) of rows (series, n, i, y): the absolute value of the transform, k from 0 to n div 2.

    ``n`` is the length of the series, ``i`` a place from 0 to n - 1, at most one
    row each; absent places are zero and ``series`` may be null.  Squares of places
    are kept in 64 bits, so n is at most 3 x 10^9.  ``most`` bounds the cells of a group.
    """
    kind = cells.schema["series"].dataType.simpleString()
    marked = cells.withColumn("p", F.ceil(F.log2(2 * F.col("n") - 1)).cast("int"))
    angle = F.lit(-np.pi) * F.expr("i * i % (2 * n)") / F.col("n")
    full = marked.select("series", "n", "p", F.expr(f"i % {_COLUMNS}").alias("line"), F.expr(f"i div {_COLUMNS}").alias("pos"),
                         (F.col("y") * F.cos(angle)).alias("re"), (F.col("y") * F.sin(angle)).alias("im"))
    # one row a block without a cell, for blocks whose places are all absent
    each = f"greatest(1L, {most}L div {_ROWS})"
    frame = marked.groupBy("series", "n", "p").agg(F.lit(None).cast("double").alias("re")).select(
        "series", "n", "p", F.explode(F.expr(f"sequence(0L, {_COLUMNS} - 1, {each})")).alias("line"),
        F.lit(None).cast("bigint").alias("pos"), "re", F.col("re").alias("im"))
    head = f"series {kind}, n bigint, p int, "
    pair = "line bigint, pos bigint, re double, im double"

    def deal(df: DataFrame, length: str, step, schema: str) -> DataFrame:
        return df.groupBy("series", "n", "p", _block(length, most).alias("block")).applyInPandas(step, head + schema)

    done = deal(full.unionByName(frame), _ROWS, _column_step(True, most), pair + ", bre double, bim double")
    done = deal(done, _COLUMNS, _row_step(True, most), pair)
    done = deal(done, _ROWS, _column_step(False, most), pair)
    done = deal(done, _COLUMNS, _row_step(False, most), "k bigint, size double")
    return done.where(F.col("k") <= F.expr("n div 2")).select("series", "n", "k", "size")
