"""Tables whose constraints refuse a write.

A table is a folder of Parquet parts and numbered version files that name the
parts they consist of.  A write is staged in a part of its own, checked, and
published by renaming a finished file to the next version, which only one writer can do
(the file system decides: atomic on HDFS, checked before on a local disk); a write that breaks a constraint raises ``ConstraintError`` and leaves the table
as it was.  An insert adds one part and reads of the table no more than the key
columns; update and delete write all rows anew.

Null keys are no duplicates and need no parent, and a CHECK that is unknown
passes, as in SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentab.operators import integrity


@dataclass(frozen=True)
class Reference:
    """``columns`` of the table name a row of ``parent`` by ``keys``."""

    columns: Sequence[str]
    parent: DataFrame
    keys: Sequence[str]


@dataclass(frozen=True)
class Child:
    """Rows of ``child`` name rows of the table by ``columns``; ``keys`` are the table's."""

    child: DataFrame
    columns: Sequence[str]
    keys: Sequence[str]


@dataclass(frozen=True)
class Constraints:
    """What every row must keep; a primary key is a unique key whose columns are not null."""

    not_null: Sequence[str] = ()
    unique: Sequence[Sequence[str]] = ()
    checks: Mapping[str, Column] = field(default_factory=dict)
    references: Mapping[str, Reference] = field(default_factory=dict)
    children: Mapping[str, Child] = field(default_factory=dict)


class ConstraintError(ValueError):
    """``broken`` maps each broken constraint to the number of rows or keys that break it."""

    def __init__(self, broken: dict[str, int]):
        super().__init__(", ".join(f"{k}: {n}" for k, n in sorted(broken.items())))
        self.broken = broken


class ConcurrentWrite(RuntimeError):
    """Another writer published first; the write may be tried again."""


def _keyed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The key as k0, k1, ..; rows with a null in it have none."""
    some = df.select(*[F.col(f"`{x}`").alias(f"k{i}") for i, x in enumerate(columns)])
    return some.dropna()


def violations(rows: DataFrame, rules: Constraints, beside: DataFrame | None = None) -> DataFrame:
    """(constraint, violations) of ``rows``, one row each, as one plan.

    ``beside`` are rows that are known to keep the rules and that a key of ``rows``
    must not repeat.  Counts are made in the tasks before they are shuffled, so
    a key held by a third of all rows is one row of each task.
    """
    single = {f"not null {x}": F.count_if(F.col(f"`{x}`").isNull()) for x in rules.not_null}
    single |= {f"check {name}": F.count_if(~condition) for name, condition in rules.checks.items()}
    parts = []
    if single:
        counts = rows.agg(*[n.alias(f"v{i}") for i, n in enumerate(single.values())])
        parts.append(counts.select(F.explode(F.array(*[
            F.struct(F.lit(name).alias("constraint"), F.col(f"v{i}").alias("violations")) for i, name in enumerate(single)])).alias("v")).select("v.*"))

    def total(name: str, broken: DataFrame, each: Column) -> None:
        parts.append(broken.agg(F.lit(name).alias("constraint"), F.coalesce(F.sum(each), F.lit(0)).alias("violations")))

    for key in rules.unique:
        names = [f"k{i}" for i in range(len(key))]
        counted = _keyed(rows, key).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
        if beside is None:
            repeated, extra = counted, F.col("n") - 1
        else:
            old = _keyed(beside, key).withColumn("old", F.lit(1))
            repeated, extra = counted.join(old, names, "left"), F.col("n") - 1 + F.coalesce("old", F.lit(0))
        total(f"unique {', '.join(key)}", repeated, extra)
    for name, ref in rules.references.items():
        names = [f"k{i}" for i in range(len(ref.columns))]
        mine = _keyed(rows, ref.columns).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
        total(f"reference {name}", mine.join(_keyed(ref.parent, ref.keys), names, "left_anti"), F.col("n"))
    for name, down in rules.children.items():
        # rows that are only added leave the children of a table their parents
        if beside is None:
            names = [f"k{i}" for i in range(len(down.columns))]
            theirs = _keyed(down.child, down.columns).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
            total(f"child {name}", theirs.join(_keyed(rows, down.keys), names, "left_anti"), F.col("n"))
    if not parts:
        return rows.sparkSession.createDataFrame([], "constraint string, violations bigint")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


class GuardedTable:
    """A table below ``path``, on any file system that Spark reads and all executors share."""

    def __init__(self, spark: SparkSession, path: str, rules: Constraints = Constraints()):
        self.spark, self.path, self.rules = spark, path.rstrip("/"), rules
        where = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = where.getFileSystem(spark._jsc.hadoopConfiguration())

    def _file(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _current(self) -> tuple[int, list[str]]:
        """Number and parts of the newest version; without one 0 and no parts."""
        folder = self._file("_versions")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        number = max((int(x) for x in names if x.isdigit()), default=0)
        if not number:
            return 0, []
        stream = self._fs.open(self._file(f"_versions/{number:012d}"))
        try:
            return number, self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
        finally:
            stream.close()

    def _publish(self, number: int, parts: list[str]) -> None:
        """The version file appears whole or not at all, and never in the place of another."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        draft, final = self._file(f"_versions/.{uuid.uuid4().hex}"), self._file(f"_versions/{number:012d}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(("\n".join(parts) + "\n").encode()))
        finally:
            stream.close()
        plain = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        plain[0] = hadoop.Options.Rename.NONE
        try:
            hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, final, plain)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if self._fs.exists(final):
                raise ConcurrentWrite(self.path) from e
            raise

    def read(self) -> DataFrame:
        """The rows of the newest version."""
        parts = self._current()[1]
        if not parts:
            raise FileNotFoundError(f"no version of {self.path}")
        return self.spark.read.parquet(*[f"{self.path}/{p}" for p in parts])

    def _commit(self, rows: DataFrame, number: int, kept: list[str], beside: DataFrame | None) -> None:
        part = f"part-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{part}")
        published = False
        try:
            staged = self.spark.read.parquet(f"{self.path}/{part}")
            found = violations(staged, self.rules, beside).where(F.col("violations") > 0).collect()
            if found:
                raise ConstraintError({r["constraint"]: r["violations"] for r in found})
            self._publish(number + 1, [*kept, part])
            published = True
        finally:
            if not published:
                self._fs.delete(self._file(part), True)

    def create(self, rows: DataFrame) -> GuardedTable:
        """The first version."""
        number, parts = self._current()
        if parts:
            raise FileExistsError(self.path)
        self._commit(rows, number, [], None)
        return self

    def insert(self, rows: DataFrame) -> None:
        """INSERT: columns that ``rows`` lack are NULL."""
        number, parts = self._current()
        table = self.read()
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name not in rows.columns]
        unknown = [x for x in rows.columns if x not in table.columns]
        if unknown:
            raise ValueError(f"no such columns: {unknown}")
        whole = rows.select("*", *missing).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in table.schema])
        self._commit(whole, number, parts, table)

    def replace(self, rows: DataFrame) -> None:
        """All rows anew, for changes that need more than a condition on one row, such as a join."""
        number = self._current()[0]
        self._commit(rows.select(*[F.col(f"`{x}`") for x in self.read().columns]), number, [], None)

    def update(self, condition: Column, values: Mapping[str, Column]) -> None:
        """UPDATE .. SET .. WHERE."""
        number = self._current()[0]
        self._commit(integrity.update_where(self.read(), condition, values), number, [], None)

    def delete(self, condition: Column) -> None:
        """DELETE WHERE."""
        number = self._current()[0]
        self._commit(integrity.delete_where(self.read(), condition), number, [], None)
