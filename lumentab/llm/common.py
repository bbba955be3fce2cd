"""What the operators of this subpackage share: written tables, words, keys and components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentab.session import scratch_path

#: words of the case-folded operators: a-z, 0-9 and everything beyond ASCII
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the reading of a file, not the
    work before it.  The folder is the one named by ``spark.checkpoint.dir``.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores behind it until no column has that name in any case."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name += "_"
    return name


def row_key(doc_id: str | Column, text: str | Column) -> Column:
    """Names a row by its content; rows equal in both share it and get equal results."""
    return F.xxhash64(doc_id, text)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` is fast but also folds letters beyond ASCII, so rows that hold
    such a capital take ``translate``.
    """
    foreign = text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    return F.when(foreign, F.translate(text, _UPPER, _UPPER.lower())).otherwise(F.lower(text))


def folded_words(text: Column) -> Column:
    """The words of ``NOT_WORD`` in order; null has none."""
    parts = F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD)
    return F.array_remove(parts, "")


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a costly column that later expressions may use often.

    A plain column would be copied into every expression that names it, inside
    lambdas even once for each element; a generator of one row is not.
    """
    return df.select(*[F.col(f"`{c}`") for c in df.columns], F.explode(F.array(value)).alias(name))


def broadcast_checked(df: DataFrame, name: str, max_bytes: int | None = None) -> tuple[DataFrame, bool]:
    """Write ``df`` and mark it for broadcast if its bytes are seen to be few.

    The bytes of all values are added up from the written table; beyond
    ``max_bytes`` (default: the session's broadcast threshold, at least 8 MB)
    the table comes back without the mark.
    """
    kept = written(df, name)
    if max_bytes is None:
        text = kept.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
        unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
        digits = text.lower().rstrip("b")
        size = int(digits[:-1]) * unit[digits[-1]] if digits[-1:] in unit else int(digits)
        max_bytes = max(size, 8 << 20)
    each = [F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) for c in kept.columns]
    total = kept.agg(F.sum(reduce(lambda a, b: a + b, each))).first()[0] or 0
    return (F.broadcast(kept), True) if total <= max_bytes else (kept, False)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node of each node's component.

    ``edges`` has the columns ``u`` and ``v`` of one type, null-free.  Every
    round is one large-star and one small-star step (Kiveris et al., 2014), two
    aggregations by node; a node's neighbours are folded to their minimum before
    they are joined back, so no neighbour list is gathered.  Rounds are
    written to the shared folder; the number of rounds follows the logarithm of
    the component size.  Running out of ``max_rounds`` raises.
    """
    now = written(edges.select("u", "v").where("u != v").distinct(), "components")
    for _ in range(max_rounds):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every node keeps the way to its own minimum
        large = large.union(low.where("u != m")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.union(least).where("u != v").distinct(), "components")
        if now.exceptAll(after).isEmpty() and after.exceptAll(now).isEmpty():
            roots = now.select(F.col("v").alias("node")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                roots.select("node", F.col("node").alias("component"))).distinct()
        now = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")
