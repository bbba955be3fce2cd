import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from lumentab.functions import arrays as A
from lumentab.functions import dates as D
from lumentab.functions import numbers as N
from lumentab.functions import strings as S
from lumentab.operators import distribution
from lumentab.operators import text as tx
from lumentab.operators import userfuncs as uf
from lumentab.operators import web

PAGE = """<html><head><title>Quotes &amp; more</title></head><body>
<div class="quote big"><span class="text">He said <b>hi</b></span><br><small class="author">Ann</small></div>
<p>plain</p><table><tr><th>a<td>b</tr><tr><td>1<table><tr><td>in</td></tr></table></td></tr></table></body>"""


def one(spark, column, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first().v


def test_elements_by_class(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "id int, html string")
    rows = web.select_by_class(df, "id", "html").collect()
    assert [(r["tag"], r["class"], r["text"].strip()) for r in rows if r["tag"] != "div"] == [
        ("span", "text", "He said hi"), ("small", "author", "Ann")]
    assert web.select_by_class(df, "id", "html", ["author"]).first()["text"] == "Ann"


def test_tables_with_missing_end_tags_and_inner_tables(spark):
    df = spark.createDataFrame([(1, PAGE)], "id int, html string")
    rows = {(r.table_no, r.row_no): r.cells for r in web.read_tables(df, "id", "html").collect()}
    assert rows == {(0, 0): ["a", "b"], (0, 1): ["1"], (1, 0): ["in"]}


def test_text_process_keeps_case_and_joins_contractions(spark):
    words = tx.clean_words(F.col("x"), ["the", "is"])
    assert one(spark, words, "x string", ("The cat, it's  Dont! THE end",)) == ["cat", "its", "Dont", "end"]


def test_tokens_are_unicode_words(spark):
    assert one(spark, tx.tokens(F.col("x")), "x string", ("Für a_b I 42",)) == ["für", "a_b", "42"]


def test_sales_job_drops_the_header_and_adds_numbers(spark):
    lines = spark.createDataFrame([("#EventId    Timestamp    Customer   State    ServiceID    Amount",),
                                   ("11  03/02/2021  7  OH  5  80.00",), ("12  03/05/2021  9  UT  6  310.25",),
                                   ("13  03/09/2021  8  OH  5  20.5",), ("bad line",)], "value string")
    assert [tuple(r) for r in uf.sales_by_state(lines).collect()] == [("UT", 310.25), ("OH", 100.5)]


def test_python_rules_of_modulo_and_division(spark):
    for a in (-7, -1, 0, 5, 7, 2**62):
        for b in (-3, 2, 3):
            row = spark.createDataFrame([(a, b)], "a bigint, b bigint")
            got = row.select(N.modulo(F.col("a"), F.col("b")).alias("m"), N.floor_div(F.col("a"), F.col("b")).alias("q")).first()
            assert (got.m, got.q) == (a % b, a // b)
    zero = spark.createDataFrame([(1, 0)], "a bigint, b bigint")
    assert tuple(zero.select(N.modulo(F.col("a"), F.col("b")), N.floor_div(F.col("a"), F.col("b"))).first()) == (None, None)


def test_string_rules(spark):
    x = F.col("x")
    for text in ("", "ada Lovelace's", "ABC", "abc1", " ", "A Title Word", "Not a Title", "McX"):
        row = spark.createDataFrame([(text,)], "x string").select(
            S.is_alnum(x), S.is_alpha(x), S.is_lower(x), S.is_upper(x), S.is_space(x), S.is_title(x), S.capitalize(x),
            S.pad_centre(x, 7, "*").alias("c"), S.find(x, "t")).first()
        assert tuple(row)[:7] == (text.isalnum(), text.isalpha(), text.islower(), text.isupper(), text.isspace(), text.istitle(), text.capitalize())
        assert len(row.c) == max(7, len(text))
        assert row[8] == text.find("t")
    assert one(spark, S.title_words(x), "x string", ("ada lovelace's",)) == "Ada Lovelace's"
    assert one(spark, S.pad_left(x, 2, "0"), "x string", ("long",)) == "long"


def test_date_rules(spark):
    import datetime as dt

    d = F.col("x").cast("date")
    assert one(spark, D.replace_year(d, 2001), "x string", ("2000-02-29",)) is None
    assert one(spark, D.ordinal(d), "x string", ("2015-05-06",)) == dt.date(2015, 5, 6).toordinal()
    assert one(spark, D.parse_ts(F.col("x")), "x string", ("junk",)) is None


def test_array_rules(spark):
    a = F.col("x")
    assert one(spark, A.remove_first(a, F.lit(2)), "x array<int>", ([1, 2, 3, 2],)) == [1, 3, 2]
    assert one(spark, A.remove_first(a, F.lit(9)), "x array<int>", ([1, 2],)) == [1, 2]
    assert one(spark, A.pop_last(a)[1], "x array<int>", ([],)) is None
    assert one(spark, A.index_of(a, F.lit(3)), "x array<int>", ([1, 3],)) == 1
    assert len(one(spark, A.zip_shortest(a, F.array(F.lit(1))), "x array<int>", ([5, 6],))) == 1


def test_left_out_end_tags(spark):
    page = ('<ul><li class="a">one<li class="a">two<ul><li class="b">in</ul><li class="a">three</ul>'
            '<p class="p">first<p class="p">second<div class="d">block</div>')
    df = spark.createDataFrame([(1, page)], "id long, html string")
    assert [r["text"] for r in web.select_by_class(df, "id", "html").orderBy("n").collect()] == [
        "one", "twoin", "in", "three", "first", "second", "block"]


def test_attributes_in_every_spelling(spark):
    df = spark.createDataFrame([(1, """<a href='x y' title=bare src="q?a=1&b=2">"""), (2, None)], "id long, html string")
    got = {(r["attribute"], r["value"]) for r in web.attribute_values(df, "id", "html").collect()}
    assert got == {("href", "x y"), ("title", "bare"), ("src", "q?a=1&b=2")}


def test_naive_bayes_scores_documents_without_known_terms(spark):
    train = spark.createDataFrame([(1, 0, "aa bb"), (2, 1, "cc"), (3, 1, "")], "doc long, label int, text string")
    test = spark.createDataFrame([(4, "zz"), (5, ""), (6, "aa")], "doc long, text string")
    out = tx.naive_bayes(tx.bag_of_words(train, "doc", tx.tokens(F.col("text"))), tx.bag_of_words(test, "doc", tx.tokens(F.col("text"))),
                         "doc", "label", [0, 1], train_docs=train, target_docs=test)
    got = {r["doc"]: (r["score_0"], r["score_1"], r["prediction"]) for r in out.collect()}
    assert set(got) == {4, 5, 6}
    # three terms; one of two words of class 0 is aa, none of the one word of class 1
    assert abs(got[6][0] - math.log(2 / 5 * 1 / 3)) < 1e-12 and abs(got[6][1] - math.log(1 / 4 * 2 / 3)) < 1e-12 and got[6][2] == 1
    assert abs(got[4][0] - math.log(1 / 3)) < 1e-12 and abs(got[5][1] - math.log(2 / 3)) < 1e-12


def test_histogram_leaves_nan_out(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (float("nan"),), (None,)], "v double")
    got = distribution.histogram(df, "v", 2).orderBy("bin").collect()
    assert [(r["left_edge"], r["right_edge"], r["n"]) for r in got] == [(0.0, 1.0, 1), (1.0, 2.0, 2)]


@pytest.mark.parametrize("most", [0, 2, 1_000_000])
def test_tfidf_whatever_is_broadcast(spark, most):
    docs = [(1, "aa bb cc aa"), (2, "aa bb dd"), (3, "aa bb cc ee"), (4, "aa ff"), (1, "cc gg"), (None, "aa hh")]
    df = spark.createDataFrame(docs, "doc long, text string").repartition("doc")
    bag = tx.bag_of_words(df, "doc", tx.tokens(F.col("text")))
    words = {}
    for d, text in docs:
        words.setdefault(d, []).extend(text.split())
    every = {t: sum(t in w for w in words.values()) for w in words.values() for t in w}
    out = tx.tfidf(bag, "doc", F.lit(6), most)
    got = {(r.doc, r.term): r.tfidf for r in out.collect()}
    want = {}
    for d, ws in words.items():
        w = {t: ws.count(t) * (np.log(7 / (1 + every[t])) + 1) for t in set(ws)}
        want |= {(d, t): v / np.sqrt(sum(x * x for x in w.values())) for t, v in w.items()}
    assert got == pytest.approx(want)
    if most == 1_000_000:  # texts are dealt by document, their words never
        assert out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1
