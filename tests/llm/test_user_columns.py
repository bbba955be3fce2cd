"""Columns of the user keep their values whatever their names; copies of a source with a huge rate."""

import math
import time

import corpus_pipeline
import numpy as np
import pytest
from conftest import words
from lumentab.llm import decontaminate, jaccard, mixing, secret_scan
from pyspark.sql import functions as F

CLASH = ["__key", "__KEY_", "__order", "__copy", "__rate", "__u", "__n", "__from", "__steps", "__source", "copy", "row_key"]


@pytest.fixture
def clashing(spark):
    texts = [" ".join(words(60, i)) for i in range(8)] + [" ".join(words(20, 50)) + " AKIA" + "Q7" * 8, " ".join(words(60, 1)), None, ""]
    rows = [(i, t, "en", f"s{i % 2}", *[f"{c}-{i}" for c in CLASH]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASH))


def kept_values(out):
    for r in out.collect():
        assert [r[c] for c in CLASH] == [f"{c}-{r['doc_id']}" for c in CLASH]
        yield r["doc_id"]


def test_values_of_clashing_columns(spark, clashing):
    items = spark.createDataFrame([("x", " ".join(words(60, 2)[10:25]))], "item_id string, text string")
    every = set(range(12))
    assert set(kept_values(jaccard.keep_one(clashing))) == every - {9}
    for remove, left in (("documents", every - {2}), ("spans", every)):
        assert set(kept_values(decontaminate.decontaminate(clashing, items, remove=remove))) == left
    assert set(kept_values(secret_scan.remove_secrets(clashing))) == every
    mixed = mixing.mix_sources(clashing, extra=True)
    assert mixed.columns == [*clashing.columns, "__copy_", "__rate_", "__order_"]
    assert set(kept_values(mixed)) <= every
    staged = corpus_pipeline.mix_sources(spark, clashing, "")
    assert staged.columns == [*clashing.columns, "copy_"] and staged.schema["copy_"].dataType.typeName() == "integer"
    assert set(kept_values(staged)) <= every


def test_draws_around_the_mean_equal_the_table(spark):
    rows = [(float(rate), (i + 0.5) / 40) for rate in (1024, 1500.5, 4000) for i in range(40)]
    df = spark.createDataFrame(rows, "rate double, u double")
    table = F.size(F.filter(mixing.poisson_steps(F.col("rate")), lambda s: s <= F.col("u")))
    for r in df.select("rate", "u", mixing.poisson_around_mode(F.col("rate"), F.col("u")).alias("a"), table.alias("b")).collect():
        assert r["a"] == r["b"]


def test_rate_of_a_hundred_million(spark):
    began = time.time()
    df = spark.range(8).select((F.lit(1e8) + F.col("id")).alias("rate"), ((F.col("id") + 0.5) / 8).alias("u"))
    got = [r[0] for r in df.select(mixing.poisson_around_mode(F.col("rate"), F.col("u"))).collect()]
    assert got == sorted(got) and all(abs(n - 1e8) < 3e4 for n in got)
    # the quartiles of a normal distribution with the same mean and deviation
    assert abs((got[6] - got[1]) / math.sqrt(1e8) - 2 * 0.8871) < 0.02
    assert time.time() - began < 60


def test_one_short_document_in_its_own_source(spark):
    rows = [(0, "ab", "tiny")] + [(i, "x" * 60_000, "long") for i in range(1, 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rate = (3 + 600_010) / 2 / 3
    n = mixing.mix_sources(docs).where("source = 'tiny'").count()
    assert abs(n - rate) < 6 * math.sqrt(rate) and n > mixing.PIECE
    assert np.isfinite(rate)
