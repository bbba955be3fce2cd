"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and is written as Parquet before the next one reads it.  All but the last return
the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumentab.llm import decontaminate, jaccard, mixing, secret_scan, toxicity
from lumentab.llm.common import free_name, read, written
from lumentab.llm.quality import fold


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go; learned from the labelled rows of the training folds."""
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, read(spark, sf_dir, "labels"), fold(4) != 2))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the smallest id stays."""
    return jaccard.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values of live-looking secrets are replaced by a mark; no document goes.

    ``n_chars`` follows the text.
    """
    done = secret_scan.remove_secrets(docs)
    if "n_chars" not in docs.columns:
        return done
    kind = docs.schema["n_chars"].dataType
    return done.withColumn("n_chars", F.when(F.contains("text", F.lit("[SECRET]")), F.length("text").cast(kind)).otherwise(F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source at the same weight; the number of each copy follows as ``copy``, or ``copy_`` where there is such a column."""
    mixed = mixing.mix_sources(docs, extra=True)
    number = mixed.columns[len(docs.columns)]
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"`{number}`").cast("int").alias(free_name(docs.columns, "copy")))


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("benchmark", drop_benchmark),
          ("secrets", redact_secrets), ("mixing", mix_sources)]

#: the first stage is a fitted model, which SQL cannot express; tests/llm/test_pipeline.py checks the stages by brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
