"""Mixing sources to target weights by Poisson replication.

Every document draws its number of copies from a Poisson distribution whose
mean is the repetition rate of its source.  The draw inverts the distribution
at a number made from a seeded hash of the id, so it does not depend on the
partitioning or on retries.  Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentab.llm.common import broadcast_checked, free_name

#: rates above which a draw sums around the mean instead of reading a table of steps
LARGE_RATE = 1024.0
#: copies of a document that are made at once
PIECE = 65_536


def hashed_unit(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of the seed and the parts."""
    name = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") / float(1 << 52)


def poisson_steps(rate: Column) -> Column:
    """Distribution function at 0, 1, 2, … up to where what is left is below 2^-52.

    Terms are made from logarithms, so large means do not underflow.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("out"))

    def step(acc, k):
        log = acc["log"] + F.log(rate) - F.log(k.cast("double"))
        total = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(acc["out"], F.array(total)).alias("out"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step)["out"]).otherwise(F.array(F.lit(1.0)))


def poisson_around_mode(rate: Column, u: Column) -> Column:
    """The value of a large Poisson distribution at ``u``, summed from 12 deviations below the mean on.

    The first term comes from Stirling's series, each next one from the one
    before; nothing is kept but the running sum, so a draw takes about 24
    deviations of steps.  What lies further out is less than 2^-52.
    """
    first = F.floor(rate - 12 * F.sqrt(rate)).cast("double")
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("bigint")
    # with d = first - rate: log of rate^k e^-rate / k! without the difference of large numbers
    d = first - rate
    log = -first * F.log1p(d / rate) + d - F.log(2 * math.pi * first) / 2 - 1 / (12 * first) + 1 / (360 * first * first * first)
    start = F.struct(F.exp(log).alias("term"), F.lit(0.0).alias("sum"), first.cast("bigint").alias("n"))

    def step(acc, k):
        total = acc["sum"] + acc["term"]
        return F.struct((acc["term"] * rate / (k + 1)).alias("term"), total.alias("sum"), F.when(total <= u, k + 1).otherwise(acc["n"]).alias("n"))

    return F.aggregate(F.sequence(first.cast("bigint"), last), start, step)["n"]


def source_rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, default_weight: float = 1.0,
                 size: float = 1.0, source: str = "source", text: str = "text") -> DataFrame:
    """(source, mass, weight, rate): mean copies of each document of a source.

    The mass of a document is its characters plus one.  The rates give every
    source its weight's share of ``size`` times the whole mass.
    """
    mass = docs.groupBy(F.col(source).alias("source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0)).cast("bigint") + 1).alias("mass"))
    weight = F.lit(float(default_weight))
    for name, w in (weights or {}).items():
        if w < 0:
            raise ValueError("weights are not negative")
        weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    weighed = mass.withColumn("weight", weight)
    total = weighed.agg(F.struct(F.sum("mass").alias("mass"), F.sum("weight").alias("weight"))).scalar()
    return weighed.withColumn("all", total).select("source", "mass", "weight", F.coalesce(F.try_divide(
        F.col("weight") * F.col("all.mass") * size, F.col("all.weight") * F.col("mass")), F.lit(0.0)).alias("rate"))


def mix_sources(docs: DataFrame, weights: Mapping[str | None, float] | None = None, seed: int = 17,
                default_weight: float = 1.0, size: float = 1.0, doc_id: str = "doc_id", text: str = "text",
                source: str = "source", extra: bool = False) -> DataFrame:
    """The copies, in a globally shuffled order, with the columns of ``docs``.

    With ``extra`` the columns ``__copy`` (from 0), ``__rate`` and ``__order`` (the
    shuffle key) follow, with underscores behind where ``docs`` has such a column.  Copies are dealt to partitions by the shuffle key and
    ordered by it inside, so each partition is a random sample of the whole, and
    a source that holds most rows is spread like any other.

    The draw depends on the id alone: rows that repeat an id get the same count,
    null ids share one draw.  A null source is a source of its own; null and
    empty texts have mass one; a weight of zero removes its source; an empty
    table gives an empty one.  The table of rates has one row per source; it is
    broadcast after its bytes were checked, and joined by a shuffle beyond that.
    """
    name = {x: free_name(docs.columns, f"__{x}") for x in ("source", "rate", "steps", "u", "n", "copy", "order", "from")}
    at = {x: F.col(f"`{n}`") for x, n in name.items()}
    few = F.col("rate") <= LARGE_RATE
    rates = source_rates(docs, weights, default_weight, size, source, text).select(
        F.col("source").alias(name["source"]), F.col("rate").alias(name["rate"]), F.when(few, poisson_steps(F.least("rate", F.lit(LARGE_RATE)))).alias(name["steps"]))
    rates, _ = broadcast_checked(rates, "rates", 64 << 20)
    drawn = docs.join(rates, F.col(f"`{source}`").eqNullSafe(at["source"])).withColumn(name["u"], hashed_unit(seed, F.col(f"`{doc_id}`")))
    drawn = drawn.withColumn(name["n"], F.when(at["steps"].isNotNull(), F.size(F.filter(at["steps"], lambda s: s <= at["u"])).cast("bigint")).otherwise(
        poisson_around_mode(at["rate"], at["u"])))
    # in two levels, so that no array is longer than a piece or their number
    pieces = drawn.where(at["n"] > 0).drop(name["steps"], name["u"], name["source"]).withColumn(
        name["from"], F.explode(F.sequence(F.lit(0).cast("bigint"), at["n"] - 1, F.lit(PIECE).cast("bigint"))))
    copies = pieces.withColumn(name["copy"], F.explode(F.sequence(at["from"], F.least(at["from"] + PIECE, at["n"]) - 1)))
    mixed = copies.withColumn(name["order"], F.xxhash64(F.lit(seed), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("null")), at["copy"].cast("int")))
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    out = mixed.repartition(width, at["order"]).sortWithinPartitions(at["order"])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *([at["copy"], at["rate"], at["order"]] if extra else []))


def op3(docs: DataFrame) -> DataFrame:
    """Every source at the same weight, the size of the corpus kept."""
    return mix_sources(docs, extra=True).select(
        "doc_id", F.col("__copy").cast("bigint").alias("copy"), "source", "lang", "text", "n_chars",
        F.round("__rate", 6).alias("rate"))


OP3_SQL = r"""
WITH RECURSIVE m AS (SELECT source, CAST(sum(coalesce(length(text), 0) + 1) AS BIGINT) AS mass FROM documents GROUP BY source),
r AS (SELECT source, 1.0::DOUBLE * (SELECT sum(mass) FROM m)::DOUBLE / ((SELECT count(*) FROM m)::DOUBLE * mass) AS rate FROM m),
s AS (
  SELECT source, rate, 0 AS k, -rate AS logp, exp(-rate) AS cdf FROM r
  UNION ALL
  SELECT source, rate, k + 1, logp + ln(rate) - ln((k + 1)::DOUBLE), cdf + exp(logp + ln(rate) - ln((k + 1)::DOUBLE))
  FROM s WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
u AS (
  SELECT doc_id, source, lang, text, n_chars,
    CAST(('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0 AS u
  FROM documents),
c AS (SELECT u.doc_id, u.source, u.lang, u.text, u.n_chars, s.rate, s.k FROM u JOIN s ON u.source IS NOT DISTINCT FROM s.source AND s.cdf <= u.u)
SELECT doc_id, CAST(k AS BIGINT) AS copy, source, lang, text, n_chars, round(rate, 6) AS rate FROM c
"""
