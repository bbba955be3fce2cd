"""Classifiers by held-out accuracy, top-k and URL filter by brute force, and the pipeline."""

import math
import zlib

import corpus_pipeline
import numpy as np
from conftest import SMALL
from lumentab.llm import quality, topk, toxicity, urls
from lumentab.llm.common import read, written
from pyspark.sql import functions as F

MIDDLE = "/root/testdata/sf0.01"


def check_scores(spark, out, label, k, remainder, least):
    labels = {r["doc_id"]: r[label] for r in read(spark, MIDDLE, "labels").collect()}
    rows = out.collect()
    assert len(rows) == read(spark, MIDDLE, "documents").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % k == remainder) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in held) >= least * len(held)


def test_quality(spark):
    check_scores(spark, quality.op9(read(spark, MIDDLE, "documents"), read(spark, MIDDLE, "labels")), "quality", 5, 0, 0.95)


def test_toxicity(spark):
    check_scores(spark, toxicity.op7(read(spark, MIDDLE, "documents"), read(spark, MIDDLE, "labels")), "toxic", 4, 2, 0.9)


def test_models_without_labels(spark, docs):
    d = docs([(1, None), (2, ""), (3, "one two"), (3, "one two"), (4, "x" * 300_000)])
    none = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.op9(d, none).collect()} == {0.5}
    assert {r["score"] for r in toxicity.op7(d, none).collect()} == {0.0}
    assert quality.op9(d.limit(0), none).count() == 0 and toxicity.op7(d.limit(0), none).count() == 0
    assert toxicity.drop_toxic(d, None).count() == 5


def test_gapped_insults():
    bad, fine = ["idiot", "moron", "stupid", "worthless"], ["table", "weather", "running", "morning", "student", "worth", "studio", "folder"]
    m = toxicity.fit_words(bad + fine, np.array([1.0] * 4 + [-1.0] * 8), np.ones(12), 12, 1e-4, 0)
    value = lambda t: max(m.known(toxicity.tokens(t))[x] for x in toxicity.tokens(t))
    assert min(value(x) for x in ("idiot!!", "stu_pid", "m0ron", "stupiid", "i d i o t", "worthlesss")) > max(value(x) for x in ("student", "morning", "weather"))


def test_isotonic():
    v = quality.isotonic(np.arange(5.0), np.array([0.0, 2, 1, 3, 2]), np.array([2.0, 2, 2, 3, 3]))
    assert (np.diff(v) >= 0).all() and math.isclose(v[1], 0.75)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist(), i, 0) for i in range(300)] + [(i, [0.5] * 8, 1, 1) for i in range(300, 340)]
    rows += [(400, None, 1, 1), (401, [None] * 8, 1, 1), (402, [float("nan")] * 8, 1, 1), (403, [float("inf")] + [0.0] * 7, 1, 1), (None, [1.0] * 8, 1, 1), (305, [9.0] * 8, 1, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score int")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, shard_rows=64, query_rows=4).collect()}
    good = [(r[0], np.floor(64 * np.array(r[1], float))) for r in rows if r[0] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all()]
    want = {}
    for q, v in good:
        if q % 20 == 0:
            best = sorted((-int(v @ w), i) for i, w in good if i != q)[:20]
            want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want
    assert topk.op4(df.limit(0)).count() == 0


def test_url_filter(spark):
    link = '<link href="{}" rel="canonical">'
    rows = [(1, "http://sub.Example.org/es/1", "<p>"), (2, "https://a.net/x?utm_source=q#f", link.format("http://example.org/es/9")),
            (3, "http://www.a.net/x/", None), (4, "http://b.net/y", '<meta http-equiv=refresh content="0; url=/z">'), (5, "https://m.b.net/z.html", ""),
            (6, "http://c.com/de/1", ""), (7, "http://c.net/", link.format("//c.com/de/1")), (8, "http://c.net", link.format("http://k.com/fr/2")),
            (9, None, None), (10, "no url", "x"), (11, "http://x.com", ""), (11, "http://x.com", ""), (12, "http://myexample.org/es/", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.op5(df).collect()}
    assert got[1] == ("sub.example.org", "/es/1", "example.org/es/", "block")
    assert got[2][2:] == (None, "block") and got[3][2:] == (None, "block")
    assert got[4][2:] == (None, "allow") and got[5][2:] == (None, "allow")
    assert got[6][2:] == ("com/de/", "block") and got[7][3] == "allow" and got[8][3] == "allow"
    assert got[9] == ("", "", None, "allow") and got[10] == ("", "", None, "allow") and got[11] == ("x.com", "", None, "allow")
    assert got[12][2:] == ("org/", "allow")
    assert urls.op5(df).count() == len(rows) and urls.op5(df.limit(0)).count() == 0
    assert urls.keep_allowed(df).columns == df.columns


def test_pipeline_stages(spark):
    docs = read(spark, SMALL, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, SMALL), f"t-{name}")
        seen[name] = docs.count()
        if name != "mixing":
            assert docs.columns == before.columns
    assert seen["toxicity"] >= seen["near_copies"] >= seen["benchmark"] == seen["secrets"] > 0
    assert "copy" in docs.columns
    assert corpus_pipeline.run(spark, SMALL).count() == seen["mixing"]
