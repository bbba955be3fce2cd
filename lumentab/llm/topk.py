"""Exact top-k by inner product with sorted lists read in order and no random access.

Candidates are dealt to shards.  In a shard every dimension is a sorted list.
A query reads its lists from the end that its own component favours, deeper
round by round.  What was read and the frontier of each list bound a
candidate's score from below and above.  A query stops once no outsider can
reach its k-th lower bound; what is left is scored in full.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: beyond this bound on a score, sums of doubles would not be exact
EXACT = float(1 << 53)


def usable(vector: Column) -> Column:
    """No null, no NaN, no infinity, and not null itself."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))), F.lit(False))


def _rounds(n: int, first: float) -> list[int]:
    depths, share = [], first
    while share < 1:
        depths.append(max(1, int(n * share)))
        share *= 1.7
    return depths


def nra_block(queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, own: np.ndarray, k: int,
              first: float = 0.12) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the k best of a shard for each query, read from sorted lists."""
    n, d = rows.shape
    order = np.sort(rows, axis=0)
    least, most = order[0], order[-1]
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    alive = np.arange(len(queries))
    left: dict[int, np.ndarray] = {}
    for depth in _rounds(n, first):
        if len(alive) == 0:
            break
        high, low = order[n - depth], order[depth - 1]
        # an entry is read if it stands at or before the frontier of its list
        known_high, known_low = rows >= high, rows <= low
        below = plus[alive] @ np.where(known_high, rows, least).T + minus[alive] @ np.where(known_low, rows, most).T
        above = plus[alive] @ np.where(known_high, rows, high).T + minus[alive] @ np.where(known_low, rows, low).T
        below[own[alive, None] == ids[None, :]] = -np.inf
        above[own[alive, None] == ids[None, :]] = -np.inf
        kth = np.partition(below, n - k, axis=1)[:, n - k] if n > k else np.full(len(alive), -np.inf)
        open_ = above >= kth[:, None]
        few = open_.sum(axis=1) <= max(4 * k, n // 16)
        for at in np.flatnonzero(few):
            left[alive[at]] = np.flatnonzero(open_[at])
        alive = alive[~few]
    for q in alive:  # read to the end of the lists
        left[q] = np.flatnonzero(ids != own[q])
    for q, at in left.items():
        at = at[ids[at] != own[q]]
        score = rows[at] @ queries[q]
        if len(at) > k:
            cut = np.partition(score, len(score) - k)[len(score) - k]
            at, score = at[score >= cut], score[score >= cut]
        best = np.lexsort((ids[at], -score))[:k]
        yield q, ids[at][best], score[best]


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = np.floor(64.0 * np.asarray(v, dtype=np.float64))
    return out


def _cell(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        asks, rest = pdf[pdf["ask"]], pdf[~pdf["ask"]]
        parts: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(asks) and len(rest):
            width = max(pdf["v"].map(len).max(), 1)
            q, c = _matrix(asks["v"], width), _matrix(rest["v"], width)
            if np.abs(q).sum(axis=1).max() * max(np.abs(c).max(), 1) >= EXACT:
                raise ValueError("scores beyond 2^53 are not exact integers")
            own, ids = asks["id"].to_numpy(), rest["id"].to_numpy()
            for i, who, score in nra_block(q, ids, c, own, k):
                parts["query_id"].append(np.full(len(who), own[i]))
                parts["vec_id"].append(who)
                parts["score"].append(score.astype(np.int64))
        return pd.DataFrame({n: np.concatenate(x) if x else np.empty(0, np.int64) for n, x in parts.items()})
    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 20, shard_rows: int = 8192, query_rows: int = 1024,
          vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of all other vectors.

    Components become floor(64 x); the score is the integer inner product; ties
    go to the smaller id.  ``queries`` picks the query rows.  Queries and
    candidates meet in cells of at most about ``query_rows`` x ``shard_rows``, whose
    numbers follow from the counted rows; a cell returns k rows for each query.

    Vectors that are null or hold a null, NaN or infinite component take no part,
    nor do rows with a null id; an empty vector scores 0 and missing components
    of a shorter vector are 0.  Rows that repeat an id are candidates each, but
    never for a query with that id; queries that repeat an id are asked once per
    distinct vector.  Other columns are not looked at.  Scores that need more than
    53 bits raise an error.
    """
    base = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"),
                          F.coalesce(queries, F.lit(False)).alias("ask")).where(F.col("id").isNotNull() & usable(F.col("v")))
    n, asked = base.agg(F.count(F.lit(1)), F.count_if("ask")).first()
    shards, blocks = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(asked / query_rows))
    spot = F.xxhash64("id", "v")
    rest = base.select(F.pmod(spot, F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(
        F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("ask"), "id", "v")
    asks = base.where("ask").dropDuplicates(["id", "v"]).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(
        spot, F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("ask"), "id", "v")
    found = asks.union(rest).groupBy("shard", "block").applyInPandas(_cell(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4(vectors: DataFrame) -> DataFrame:
    return top_k(vectors, F.col("vec_id") % 20 == 0)


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
