"""Text, web pages, user functions and the line-oriented job."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumentab.operators import text as tx
from lumentab.operators import userfuncs as uf
from lumentab.operators import web
from lumentab.operators.aggregate import describe
from lumentab.operators.joins import checked_broadcast
from lumentab.plans.registry import query
from lumentab.plans.statistics import panel, rounded, _DESC, _PANEL
from lumentab.session import spread

c = F.col

# fixed values: a short stop list given to both sides of the comparison
STOP = ("the", "a", "an", "and", "or", "of", "to", "in", "is", "it", "for", "on", "with", "at", "by", "are", "was",
        "this", "that", "from", "be", "as", "not", "und", "der", "die", "das", "el", "la", "le", "les", "de", "des")
_STOP = ", ".join(f"'{w}'" for w in STOP)


@query("text_length", "X1, A7", f"""
WITH d AS (SELECT quality, CAST(LENGTH(text) AS DOUBLE) AS n FROM documents JOIN labels USING (doc_id))
SELECT quality, {_DESC.format(v='n')} FROM d GROUP BY quality""")
def text_length(t):
    d = t.documents.join(t.labels, "doc_id").select("quality", F.length("text").cast("double").alias("n"))
    return rounded(describe(d, "n", ["quality"]), 4)


_CLEAN = rf"""list_filter(regexp_split_to_array(regexp_replace(text, '[!-/:-@\[-`{{-~]', '', 'g'),
 '[\t\n\x0b\f\r\x1c-\x1f\x{{85}}\p{{Z}}]+'), lambda w: w <> '' AND NOT list_contains([{_STOP}], LOWER(w)))"""


@query("text_process", "X2", f"SELECT doc_id, array_to_string({_CLEAN}, ' ') AS words FROM documents")
def text_process(t):
    return spread(t.documents.select("doc_id", "text")).select("doc_id", F.array_join(tx.clean_words(c("text"), STOP), " ").alias("words"))


_TOK = r"regexp_extract_all(LOWER(text), '[\p{L}\p{N}_]{2,}')"


@query("tokenize", "X3", f"SELECT doc_id, CAST(LEN({_TOK}) AS INTEGER) AS n, array_to_string({_TOK}, ' ') AS tokens FROM documents")
def tokenize(t):
    words = tx.tokens(c("text"))
    return spread(t.documents.select("doc_id", "text")).select("doc_id", F.size(words).alias("n"), F.array_join(words, " ").alias("tokens"))


_BAG = f"bag AS (SELECT doc_id, term, COUNT(*) AS tf FROM (SELECT doc_id, UNNEST({_TOK}) AS term FROM documents) GROUP BY 1, 2)"


def bag(t):
    return tx.bag_of_words(spread(t.documents.select("doc_id", "text")), "doc_id", tx.tokens(c("text")))


@query("bag_of_words", "X4", f"WITH {_BAG} SELECT doc_id, term, tf FROM bag")
def bag_of_words(t):
    return bag(t)


@query("bag_shape", "X4, A35", f"""
WITH {_BAG} SELECT COUNT(DISTINCT doc_id) AS n_docs, COUNT(DISTINCT term) AS n_terms, COUNT(*) AS non_zero, CAST(SUM(tf) AS BIGINT) AS total FROM bag""")
def bag_shape(t):
    return tx.bag_shape(bag(t), "doc_id")


@query("tfidf", "X5", f"""
WITH {_BAG}, d AS (SELECT term, COUNT(*) AS df FROM bag GROUP BY 1), n AS (SELECT COUNT(*) AS n FROM documents),
w AS (SELECT doc_id, term, tf, tf * (LN((1 + n) / (1 + df)) + 1) AS w FROM bag JOIN d USING (term), n)
SELECT doc_id, term, tf, ROUND(w / SQRT(SUM(w * w) OVER (PARTITION BY doc_id)), 6) AS tfidf FROM w""")
def tfidf(t):
    n = t.documents.agg(F.count(F.lit(1))).scalar()
    # texts are dealt by document, which is less than their words; nothing moves between documents after that
    words = tx.bag_of_words(t.documents.select("doc_id", "text").repartition("doc_id"), "doc_id", tx.tokens(c("text")))
    return rounded(tx.tfidf(words, "doc_id", n))


@query("naive_bayes", "X6", f"""
WITH {_BAG}, tr AS (SELECT doc_id, quality, term, tf FROM bag JOIN labels USING (doc_id) WHERE doc_id % 3 <> 0),
te AS (SELECT doc_id, term, tf FROM bag JOIN labels USING (doc_id) WHERE doc_id % 3 = 0),
m AS (SELECT term, SUM(CASE WHEN quality = 0 THEN tf ELSE 0 END) AS n0, SUM(CASE WHEN quality = 1 THEN tf ELSE 0 END) AS n1 FROM tr GROUP BY 1),
s AS (SELECT COUNT(*) AS v, SUM(n0) AS t0, SUM(n1) AS t1 FROM m),
p AS (SELECT LN(COUNT(*) FILTER (quality = 0) / COUNT(*)) AS p0, LN(COUNT(*) FILTER (quality = 1) / COUNT(*)) AS p1 FROM documents JOIN labels USING (doc_id) WHERE doc_id % 3 <> 0),
k AS (SELECT doc_id, SUM(tf * LN((n0 + 1) / (t0 + v))) AS s0, SUM(tf * LN((n1 + 1) / (t1 + v))) AS s1 FROM te JOIN m USING (term), s GROUP BY doc_id),
sc AS (SELECT doc_id, COALESCE(s0, 0) + p0 AS s0, COALESCE(s1, 0) + p1 AS s1 FROM documents JOIN labels USING (doc_id) LEFT JOIN k USING (doc_id), p WHERE doc_id % 3 = 0)
SELECT doc_id, ROUND(s0, 4) AS score_0, ROUND(s1, 4) AS score_1, CASE WHEN s0 >= s1 THEN 0 ELSE 1 END AS prediction FROM sc""")
def naive_bayes(t):
    docs = spread(t.documents.select("doc_id", "text")).join(t.labels.select("doc_id", "quality"), "doc_id")
    labelled = tx.bag_of_words(docs, "doc_id", tx.tokens(c("text")))
    train, test = labelled.where(c("doc_id") % 3 != 0), labelled.where(c("doc_id") % 3 == 0)
    return rounded(tx.naive_bayes(train, test.drop("quality"), "doc_id", "quality", [0, 1],
                                  train_docs=docs.where(c("doc_id") % 3 != 0), target_docs=docs.where(c("doc_id") % 3 == 0)), 4)


# one, three or five stars: toxic and poor, in between, neither
_STARS = "3 + 2 * quality - 2 * toxic"


@query("text_pipeline", "X7, X8", rf"""
WITH d AS (SELECT doc_id, {_STARS} AS stars, {_CLEAN} AS words FROM documents JOIN labels USING (doc_id) WHERE {_STARS} IN (1, 5)),
bag AS (SELECT doc_id, stars, term, COUNT(*) AS tf FROM (SELECT doc_id, stars, UNNEST(words) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, COUNT(*) AS df FROM bag WHERE doc_id % 10 < 7 GROUP BY term),
n AS (SELECT COUNT(*) AS n FROM d WHERE doc_id % 10 < 7),
w AS (SELECT doc_id, stars, term, tf * (LN((1 + n) / (1 + df)) + 1) AS w FROM bag JOIN df USING (term), n),
x AS (SELECT doc_id, stars, term, w / SQRT(SUM(w * w) OVER (PARTITION BY doc_id)) AS x FROM w),
m AS (SELECT term, SUM(CASE WHEN stars = 1 THEN x ELSE 0 END) AS n0, SUM(CASE WHEN stars = 5 THEN x ELSE 0 END) AS n1 FROM x WHERE doc_id % 10 < 7 GROUP BY term),
s AS (SELECT COUNT(*) AS v, SUM(n0) AS t0, SUM(n1) AS t1 FROM m),
p AS (SELECT LN(COUNT(*) FILTER (stars = 1) / COUNT(*)) AS p0, LN(COUNT(*) FILTER (stars = 5) / COUNT(*)) AS p1 FROM d WHERE doc_id % 10 < 7),
k AS (SELECT doc_id, SUM(x * LN((n0 + 1) / (t0 + v))) AS s0, SUM(x * LN((n1 + 1) / (t1 + v))) AS s1 FROM x JOIN m USING (term), s WHERE doc_id % 10 >= 7 GROUP BY doc_id)
SELECT doc_id, CAST(stars AS INTEGER) AS label, ROUND(COALESCE(s0, 0) + p0, 4) AS score_1, ROUND(COALESCE(s1, 0) + p1, 4) AS score_5
FROM d LEFT JOIN k USING (doc_id), p WHERE doc_id % 10 >= 7""")
def text_pipeline(t):
    stars = t.labels.select("doc_id", F.expr(_STARS).cast("int").alias("label"))
    rated = t.documents.select("doc_id", "text").join(stars, "doc_id").where(c("label").isin(1, 5))
    train, test = rated.where(c("doc_id") % 10 < 7), rated.where(c("doc_id") % 10 >= 7)
    out = tx.text_pipeline(train, test, "doc_id", "label", [1, 5], lambda text: tx.clean_words(text, STOP))
    return rounded(out.drop("prediction").join(test.select("doc_id", "label"), "doc_id"), 4).select("doc_id", "label", "score_1", "score_5")


# --- web pages -------------------------------------------------------------

@query("html_title", "H1", r"""
WITH t AS (SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages)
SELECT page_id, NULLIF(replace(replace(replace(replace(replace(replace(title, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)),
 '&nbsp;', chr(160)), '&amp;', '&'), '') AS title FROM t""")
def html_title(t):
    return t.pages.select("page_id", web.title(c("html")).alias("title"))


# the only elements with a class in the test pages are <div class="ad">text</div>
_AD = """(SELECT page_id, regexp_extract(html, '<div class="ad">([^<]*)</div>', 1) AS text FROM pages WHERE contains(html, 'class="ad"'))"""


@query("html_select", "H2, H5", f"""
SELECT page_id, CAST(0 AS INTEGER) AS n, 'div' AS tag, 'ad' AS class, text, CAST(NULL AS VARCHAR) AS href FROM {_AD}""")
def html_select(t):
    found = web.select_by_class(spread(t.pages), "page_id", "html")
    return found.select("page_id", "n", "tag", "class", "text", F.try_element_at("attrs", F.lit("href")).alias("href"))


@query("html_titles_by_class", "H5", "SELECT page_id, 'book-' || page_id AS title FROM pages WHERE page_id % 5 = 1")
def html_titles_by_class(t):
    # the given pages rate nothing: each gets one item in the layout that is scraped, rated Two or Three, at its end
    rated = F.when(c("page_id") % 5 == 1, "Two").otherwise("Three")
    item = F.concat(F.lit('<article class="product_pod"><p class="star-rating '), rated, F.lit('"></p><h3><a title="book-'),
                    c("page_id").cast("string"), F.lit('">link</a></h3></article>'))
    return web.titles_of_items(t.pages.select("page_id", F.concat(F.coalesce("html", F.lit("")), item).alias("html")),
                               "page_id", "html", "product_pod", ["star-rating", "Two"])


@query("html_links", "H3", r"""
SELECT page_id, regexp_extract(h, '\s(\w+)=', 1) AS attribute, regexp_extract(h, '="([^"]*)"', 1) AS value
FROM (SELECT page_id, UNNEST(regexp_extract_all(html, '\s(?:href|src|title)="[^"]*"')) AS h FROM pages)""")
def html_links(t):
    return web.attribute_values(t.pages, "page_id", "html")


@query("html_distinct", "H4", f"SELECT DISTINCT 'ad' AS class, TRIM(text) AS text FROM {_AD}")
def html_distinct(t):
    found = web.select_by_class(spread(t.pages), "page_id", "html")
    return found.select("class", F.trim("text").alias("text")).distinct()


@query("html_tables", "H6, S15", """
SELECT c_custkey, CAST(0 AS INTEGER) AS table_no, CAST(r AS INTEGER) AS row_no, CASE r WHEN 0 THEN 'name|segment' ELSE c_name || '|' || c_mktsegment END AS cells
FROM customer, range(0, 2) x(r)""")
def html_tables(t):
    page = F.concat(F.lit("<html><body><table><tr><th>name</th><th>segment</th></tr><tr><td> "), c("c_name"),
                    F.lit("</td><td>"), c("c_mktsegment"), F.lit("</td></tr></table></body></html>"))
    pages = t.customer.select("c_custkey", page.alias("html"))
    return web.read_tables(pages, "c_custkey", "html").withColumn("cells", F.array_join("cells", "|"))


# --- row functions and the line job ----------------------------------------

@query("rdd_flatmap", "B1", """
SELECT w, COUNT(*) AS n FROM (SELECT LOWER(UNNEST(string_split(text, ' '))) AS w FROM conversations) WHERE LENGTH(w) > 3 GROUP BY w""")
def rdd_flatmap(t):
    words = t.conversations.select(F.explode(F.split("text", " ")).alias("w")).select(F.lower("w").alias("w"))
    return words.where(F.length("w") > 3).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


@query("rdd_stats", "B2", """
SELECT COUNT(*) AS n, MIN(event_id) AS first_id, ROUND(SUM(value), 4) AS total, ROUND(AVG(value), 6) AS mean, ROUND(STDDEV_POP(value), 6) AS stdev FROM events""")
def rdd_stats(t):
    return rounded(t.events.agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.sum("value").alias("total"),
                                F.avg("value").alias("mean"), F.stddev_pop("value").alias("stdev")), 6, total=4)


@query("sales_by_state", "B3, O5", """
SELECT c_mktsegment AS state, ROUND(SUM(o_totalprice), 2) AS amount FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY 2 DESC""")
def sales_by_state(t):
    rows = t.orders.join(t.customer, c("o_custkey") == c("c_custkey"))
    amount = c("o_totalprice").cast("decimal(18,2)").cast("string")
    lines = rows.select(F.concat_ws("   ", c("o_orderkey").cast("string"), F.date_format("o_orderdate", "MM/dd/yyyy"),
                                    c("o_custkey").cast("string"), "c_mktsegment", c("c_nationkey").cast("string"), amount).alias("value"))
    header = t.region.limit(1).select(F.lit("#EventId    Timestamp    Customer   State    ServiceID    Amount").alias("value"))
    return rounded(uf.sales_by_state(header.unionByName(lines)), 2)


@query("udf_scalar", "B4", "SELECT event_id, ROUND(value * value + 1, 6) AS out FROM events")
def udf_scalar(t):
    return rounded(uf.apply_column(t.events.select("event_id", "value"), "value", lambda v: v * v + 1, "double", "out").drop("value"))


@query("udf_row", "B5", """
SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal WHEN c_nationkey < 10 THEN 37.0::DOUBLE WHEN c_nationkey < 20 THEN 29.0::DOUBLE ELSE 24.0::DOUBLE END AS filled FROM customer""")
def udf_row(t):
    def impute(rows):
        by_class = (rows["c_nationkey"] // 10).map({0: 37.0, 1: 29.0}).fillna(24.0)
        return rows["c_acctbal"].where(rows["c_acctbal"] >= 0, by_class)
    return uf.apply_rows(t.customer, ["c_acctbal", "c_nationkey"], impute, "double", "filled").select("c_custkey", "filled")


@query("udaf", "B6", "SELECT event_type, ROUND(STDDEV_POP(value), 6) AS spread FROM events GROUP BY 1")
def udaf(t):
    # values are taken from their group's mean first, so that squares do not cancel
    means = checked_broadcast(t.events.groupBy("event_type").agg(F.avg("value").alias("mean")))
    centred = t.events.join(means, "event_type").select("event_type", (c("value") - c("mean")).alias("value"))
    out = uf.aggregate_with(
        centred, "event_type", "value", lambda v: (len(v), v.sum(), (v * v).sum()), ["n", "s", "q"],
        lambda p: F.sqrt(F.greatest(p["q"] / p["n"] - (p["s"] / p["n"]) * (p["s"] / p["n"]), F.lit(0.0))), "spread")
    return rounded(out)


@query("udtf_tokens", "B7", r"""
SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS pos, words[i] AS token FROM (SELECT conv_id, turn, words, UNNEST(range(1, LEN(words) + 1)) AS i FROM
 (SELECT conv_id, turn, regexp_extract_all(LOWER(text), '[\p{L}\p{N}_]{2,}') AS words FROM conversations))""")
def udtf_tokens(t):
    return uf.token_rows(t.conversations, "text", ["conv_id", "turn"])


@query("apply_in_pandas", "B8", f"""
WITH {_PANEL} SELECT series, CAST(day AS VARCHAR) AS day, ROUND(high / FIRST_VALUE(high) OVER (PARTITION BY series ORDER BY day), 6) AS indexed FROM panel""")
def apply_in_pandas(t):
    daily = panel(t).select("series", c("day").cast("string").alias("day"), "high")

    def index_to_first(group):
        group = group.sort_values("day")
        return group.assign(indexed=group["high"] / group["high"].iloc[0])[["series", "day", "indexed"]]
    return rounded(uf.apply_groups(daily, "series", index_to_first, "series string, day string, indexed double"))
