"""Quality classifier: ridge regression on random Fourier features, calibrated isotonically.

Every document becomes a short vector of statistics of its whole text.  Random
Fourier features approximate a Gaussian kernel over them.  Partitions sum their
share of the normal equations, so fitting uses every labelled row whatever
their number; only matrices of the model's size reach the driver.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentab.llm.common import written

_LINE = re.compile(r"\n+")
#: classes of bytes whose shares are statistics
_BYTES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n\r", b"|", b"!?", b".,;:",
          b"#$%&*@^~", b"<>{}[]()/\\=+_", b"\"'`-", bytes(range(128, 256))]
_CLASS = np.zeros((256, len(_BYTES)))
for _i, _b in enumerate(_BYTES):
    _CLASS[list(_b), _i] = 1.0
N_STATS = len(_BYTES) + 14


def statistics(text: str | None) -> np.ndarray:
    """Shares of byte classes, lengths, and repetition of words and lines of one text."""
    out = np.zeros(N_STATS)
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if n == 0:
        return out
    k = len(_BYTES)
    out[:k] = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS / len(raw)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    twins = sum(map(bytes.__eq__, words[1:], words))
    lines = [x for x in _LINE.split(text or "") if x]
    ends = Counter(map(bytes.__getitem__, words, [-1] * n))
    stops = sum(ends.get(c, 0) for c in b".,;:")
    marks = sum(v for c, v in ends.items() if c in b"#$%&*!|@^~")
    out[k:] = (np.log1p(n), np.log1p(len(raw)), lengths.mean(), lengths.std(), np.log1p(lengths.max()), len(counts) / n,
               max(counts.values()) / n, twins / n, stops / n, marks / n, len(set(lines)) / max(len(lines), 1),
               np.log1p(n / max(len(lines), 1)), sum(map(bytes.istitle, words)) / n, np.log1p(len(counts)))
    return out


def _stats_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [statistics(t).tolist() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])


class Features:
    """Standardisation and random Fourier features with a fixed seed."""

    def __init__(self, mean, spread, size: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = np.asarray(mean), np.asarray(spread)
        self.w = rng.normal(size=(len(mean), size)) / np.sqrt(len(mean))
        self.b = rng.uniform(0, 2 * np.pi, size)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.hstack([np.ones((len(x), 1)), z / 6, np.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b)])


def _x(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("x").flatten(), dtype=np.float64).reshape(batch.num_rows, -1)


def _normal_sums(features: Features):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                z = features(_x(b))
                y = np.asarray(b.column("y"), dtype=np.float64)
                part = z.T @ np.hstack([z, y[:, None], np.ones((len(y), 1))])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "row"])
    return run


def _add_rows(table: pa.Table) -> pa.Table:
    rows = np.asarray(table.column("row").combine_chunks().flatten()).reshape(table.num_rows, -1).sum(axis=0)
    return pa.table({"i": pa.array([table.column("i")[0].as_py()], pa.int32()), "row": pa.array([rows.tolist()], pa.list_(pa.float64()))})


def isotonic(low: np.ndarray, good: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing means of bins in order ``low``."""
    values: list[list[float]] = []
    for i in np.argsort(low, kind="stable"):
        values.append([good[i], count[i], 1])
        while len(values) > 1 and values[-2][0] * values[-1][1] >= values[-1][0] * values[-2][1]:
            last = values.pop()
            values[-1] = [a + b for a, b in zip(values[-1], last)]
    return np.concatenate([[s / n] * int(k) for s, n, k in values]) if values else np.empty(0)


def _score_batches(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _x(b) if b.num_rows else np.zeros((0, N_STATS))
            raw = np.clip(model["features"](x) @ model["beta"], -1, 2) if b.num_rows else np.zeros(0)
            if "knots" in model:
                # pooled scores are even; a small share of the raw one keeps their order
                raw = 0.98 * np.interp(raw, model["knots"], model["values"]) + 0.02 * np.clip(raw, 0, 1)
            keep = [b.column(i) for i in range(b.num_columns) if b.schema.names[i] != "x"]
            names = [n for n in b.schema.names if n != "x"]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(raw, pa.float64())], names=[*names, "score"])
    return run


def score_quality(docs: DataFrame, labels: DataFrame, train: Column, size: int = 384, ridge: float = 1e-4, seed: int = 5,
                  bins: int = 2000, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(doc_id, score) for every row of ``docs``; score is 0 to 1, higher for label 1.

    ``train`` is a condition on ``doc_id`` that tells which labelled rows are
    learned from; all of them are.  Scores depend on the text only.  The
    calibration pools scores in ``bins`` bins a unit, summed by Spark.

    Null and empty texts have all-zero statistics and get the score of such a
    text; null labels and labels without a document are not used, a repeated
    label counts by its largest value; repeated rows score alike; without any
    label, or with one class only, every score is that class's share, 0.5 if none.
    """
    stats = written(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _stats_batches, "doc_id bigint, x array<double>"), "quality")
    known = labels.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(label).cast("double").alias("y")).where(
        train & F.col("y").isNotNull()).groupBy("doc_id").agg(F.max("y").alias("y"))
    fit = written(stats.join(known, "doc_id").select("x", "y"), "quality-fit")
    cols = [F.element_at("x", i + 1) for i in range(N_STATS)]
    seen = fit.agg(F.count(F.lit(1)), F.avg("y"), F.array(*[F.avg(c) for c in cols]), F.array(*[F.stddev_pop(c) for c in cols])).first()
    if not seen[0] or seen[1] in (0.0, 1.0):
        return stats.select("doc_id", F.lit(0.5 if not seen[0] else float(seen[1])).alias("score"))
    features = Features(seen[2], np.maximum(np.asarray(seen[3]), 1e-6), size, seed)
    sums = fit.mapInArrow(_normal_sums(features), "i int, row array<double>")
    # in two steps, so that no group grows with the number of partitions alone
    sums = sums.withColumn("p", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("i", "p").applyInArrow(_add_rows, "i int, row array<double>")
    rows = sorted(sums.groupBy("i").applyInArrow(_add_rows, "i int, row array<double>").collect())
    a = np.array([r["row"] for r in rows])
    gram, target = a[:, :-2], a[:, -2]
    model = {"features": features, "beta": np.linalg.solve(gram + ridge * seen[0] * np.eye(len(gram)), target)}
    raw = fit.mapInArrow(_score_batches(model), "y double, score double")
    binned = raw.groupBy(F.round(F.col("score") * bins).cast("int").alias("b")).agg(
        F.sum("y").alias("good"), F.count(F.lit(1)).alias("n")).orderBy("b").collect()
    at = np.array([r["b"] for r in binned], float) / bins
    model |= {"knots": at, "values": isotonic(at, np.array([r["good"] for r in binned]), np.array([r["n"] for r in binned], float))}
    return stats.mapInArrow(_score_batches(model), "doc_id bigint, score double")


def fold(n: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_quality(docs, labels, fold(5) != 0).select(
        "doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
