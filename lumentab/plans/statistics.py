"""Aggregation, distribution, ordering, window and series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumentab.functions.numbers import pearson
from lumentab.operators import aggregate as agg
from lumentab.operators import distribution as dist
from lumentab.operators import ranking, sampling, series, windows
from lumentab.plans.registry import query
from lumentab.plans.relational import all_cells, cells, sparse, _ALL_CELLS, _CELLS, _SPARSE

c = F.col


def r(column, digits=6):
    """Rounded, without negative zero."""
    return F.round(column, digits) + F.lit(0.0)


def rounded(df, digits=6, **special):
    """Round all double columns so that summation order does not show."""
    kinds = dict(df.dtypes)
    return df.select(*[
        r(c(f"`{n}`"), special.get(n, digits)).alias(n) if kinds[n] == "double" else c(f"`{n}`") for n in df.columns])


# --- aggregation -----------------------------------------------------------

@query("agg_global", "A1", """
SELECT MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi, ROUND(AVG(o_totalprice), 4) AS mean,
 ROUND(STDDEV(o_totalprice), 4) AS std FROM orders WHERE o_orderstatus = 'F'""")
def agg_global(t):
    df = t.orders.where(c("o_orderstatus") == "F")
    return rounded(df.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"),
                          F.avg("o_totalprice").alias("mean"), F.stddev_samp("o_totalprice").alias("std")), 4)


@query("agg_count", "A2", "SELECT COUNT(*) AS n FROM orders WHERE o_totalprice > 100000 AND o_orderstatus IS NOT NULL")
def agg_count(t):
    return t.orders.where((c("o_totalprice") > 100000) & c("o_orderstatus").isNotNull()).agg(F.count(F.lit(1)).alias("n"))


@query("group_count", "A3", "SELECT l_quantity, COUNT(l_orderkey) AS n FROM lineitem GROUP BY l_quantity")
def group_count(t):
    return t.lineitem.groupBy("l_quantity").agg(F.count("l_orderkey").alias("n"))


@query("group_having", "A4", """
SELECT o_custkey, COUNT(o_orderkey) AS n FROM orders GROUP BY o_custkey HAVING COUNT(o_orderkey) > 1 ORDER BY n DESC""")
def group_having(t):
    return (t.orders.groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
            .where(c("n") > 1).orderBy(c("n").desc()))


@query("group_stats", "A6", """
SELECT l_returnflag, COUNT(l_quantity) AS l_quantity_count, ROUND(AVG(l_quantity), 6) AS l_quantity_mean,
 ROUND(STDDEV(l_quantity), 6) AS l_quantity_std, MIN(l_quantity) AS l_quantity_min, MAX(l_quantity) AS l_quantity_max,
 SUM(l_quantity) AS l_quantity_sum, COUNT(l_tax) AS l_tax_count, ROUND(AVG(l_tax), 6) AS l_tax_mean,
 ROUND(STDDEV(l_tax), 6) AS l_tax_std, MIN(l_tax) AS l_tax_min, MAX(l_tax) AS l_tax_max, ROUND(SUM(l_tax), 6) AS l_tax_sum
FROM lineitem GROUP BY l_returnflag""")
def group_stats(t):
    return rounded(agg.group_stats(t.lineitem, ["l_returnflag"], ["l_quantity", "l_tax"]))


_DESC = """COUNT({v}) AS count, ROUND(AVG({v}), 4) AS mean, ROUND(STDDEV({v}), 4) AS std, MIN({v}) AS min,
 ROUND(QUANTILE_CONT({v}, 0.25), 4) AS p25, ROUND(QUANTILE_CONT({v}, 0.5), 4) AS p50,
 ROUND(QUANTILE_CONT({v}, 0.75), 4) AS p75, MAX({v}) AS max"""


@query("describe", "A7", f"SELECT {_DESC.format(v='o_totalprice')} FROM orders")
def describe(t):
    return rounded(agg.describe(t.orders, "o_totalprice"), 4)


@query("describe_by", "A7", f"SELECT o_orderpriority, {_DESC.format(v='o_totalprice')} FROM orders GROUP BY o_orderpriority")
def describe_by(t):
    return rounded(agg.describe(t.orders, "o_totalprice", ["o_orderpriority"]), 4)


@query("describe_strings", "A7", """
SELECT CAST(SUM(n) AS BIGINT) AS count, COUNT(*) AS "unique", FIRST(role ORDER BY n DESC, role) AS top, MAX(n) AS freq
FROM (SELECT role, COUNT(*) AS n FROM conversations GROUP BY role)""")
def describe_strings(t):
    return agg.describe_strings(t.conversations, "role")


@query("describe_transpose", "A8", """
WITH s AS (SELECT l_returnflag AS f, CAST(COUNT(*) AS DOUBLE) AS n, ROUND(AVG(l_quantity), 6) AS mean, MAX(l_quantity) AS hi
 FROM lineitem GROUP BY 1),
u AS (UNPIVOT s ON n, mean, hi INTO NAME stat VALUE v)
SELECT stat, MAX(v) FILTER (f = 'A') AS "A", MAX(v) FILTER (f = 'N') AS "N", MAX(v) FILTER (f = 'R') AS "R" FROM u GROUP BY stat""")
def describe_transpose(t):
    s = t.lineitem.groupBy(c("l_returnflag").alias("f")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), r(F.avg("l_quantity")).alias("mean"), F.max("l_quantity").alias("hi"))
    return agg.transpose_summary(s, "f", ["A", "N", "R"], ["n", "mean", "hi"])


@query("distinct_count", "A9", """
SELECT COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS suppliers, COUNT(DISTINCT l_shipdate) AS days FROM lineitem""")
def distinct_count(t):
    return t.lineitem.agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"),
                          F.count_distinct("l_shipdate").alias("days"))


@query("value_counts", "A10", "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1")
def value_counts(t):
    return agg.value_counts(t.orders, "o_orderpriority")


@query("count_singletons", "A11", """
SELECT COUNT(*) AS singletons FROM (SELECT l_partkey FROM lineitem
 WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1 HAVING COUNT(*) = 1)""")
def count_singletons(t):
    year = t.lineitem.where((c("l_shipdate") >= F.lit("1996-01-01").cast("date")) & (c("l_shipdate") < F.lit("1997-01-01").cast("date")))
    return agg.count_singletons(year, "l_partkey")


@query("count_if", "A12", """
SELECT COUNT(*) FILTER (LOWER(p_name) LIKE '%ring%') AS rings, COUNT(*) FILTER (SUBSTR(p_brand, 7) = '25') AS brand25 FROM part""")
def count_if(t):
    return t.part.agg(F.count_if(F.lower("p_name").contains("ring")).alias("rings"),
                      F.count_if(F.substring("p_brand", 7, 100) == "25").alias("brand25"))


@query("pivot_mean", "A13", """
SELECT o_orderpriority, ROUND(AVG(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS "F",
 ROUND(AVG(o_totalprice) FILTER (o_orderstatus = 'O'), 4) AS "O", ROUND(AVG(o_totalprice) FILTER (o_orderstatus = 'P'), 4) AS "P"
FROM orders GROUP BY 1""")
def pivot_mean(t):
    return rounded(agg.pivot_table(t.orders, "o_orderpriority", "o_orderstatus", "o_totalprice", ["F", "O", "P"]), 4)


@query("unstack", "A14", """
SELECT CAST(isodow(ts) - 1 AS INTEGER) AS weekday, """ + ", ".join(
    f"NULLIF(COUNT(*) FILTER (hour(ts) = {h}), 0) AS h{h}" for h in range(24)) + " FROM events GROUP BY 1")
def unstack(t):
    df = t.events.select(F.weekday("ts").alias("weekday"), F.hour("ts").alias("h"))
    hours = range(24)
    wide = df.groupBy("weekday").pivot("h", list(hours)).count()
    return wide.select("weekday", *[c(f"`{h}`").alias(f"h{h}") for h in hours])


@query("row_at_max", "A15", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity = (SELECT MAX(l_quantity) FROM lineitem)")
def row_at_max(t):
    return agg.rows_at_max(t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity")


@query("idxmin_per_series", "A15", """
SELECT o_orderstatus, FIRST(o_orderkey ORDER BY o_totalprice, o_orderkey) AS o_orderkey, MIN(o_totalprice) AS o_totalprice
FROM orders GROUP BY 1""")
def idxmin_per_series(t):
    return agg.extreme_per_group(t.orders, "o_orderstatus", "o_totalprice", "o_orderkey", largest=False)


@query("corr_pair", "A16", "SELECT ROUND(CORR(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def corr_pair(t):
    return t.lineitem.agg(r(pearson(F.col("l_quantity"), F.col("l_extendedprice"))).alias("r"))


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("corr_matrix", "A16", " UNION ALL ".join(
    f"SELECT '{a}' AS c1, '{b}' AS c2, ROUND(CORR({a}, {b}), 6) + 0.0 AS r FROM lineitem" for a in _CORR for b in _CORR))
def corr_matrix(t):
    return rounded(agg.correlation_matrix(t.lineitem, _CORR))


@query("mean_median", "A18", """
SELECT ROUND(AVG(o_totalprice), 2) AS mean, ROUND(MEDIAN(o_totalprice), 2) AS median FROM orders""")
def mean_median(t):
    med = ranking.median_by(t.orders, "o_totalprice").agg(F.max("median")).scalar()
    return t.orders.agg(F.round(F.avg("o_totalprice"), 2).alias("mean")).withColumn("median", F.round(med, 2))


@query("stack_mean", "A19", """
SELECT i, j, ROUND(AVG(v), 6) AS v FROM (
 SELECT vec_id // 3 AS i, CAST(j AS INTEGER) AS j, CAST(embedding[j + 1] AS DOUBLE) AS v
 FROM embeddings, range(0, 8) r(j)) GROUP BY i, j""")
def stack_mean(t):
    return stacked(cells(t))


def stacked(m):
    frames = [m.where(c("i") % 3 == k).withColumn("i", F.floor(c("i") / 3)) for k in range(3)]
    return rounded(agg.stack_mean(frames))


@query("stack_mean_all", "A19", f"SELECT i // 3 AS i, j, ROUND(AVG(v), 6) AS v FROM {_ALL_CELLS} GROUP BY 1, 2")
def stack_mean_all(t):
    return stacked(all_cells(t))


@query("matrix_sums", "A20", f"""
SELECT j, ROUND(SUM(v), 5) AS total, ROUND(STDDEV_POP(v), 6) AS std FROM {_CELLS} GROUP BY j
UNION ALL SELECT -1, ROUND(SUM(v), 5), ROUND(STDDEV_POP(v), 6) FROM {_CELLS}""")
def matrix_sums(t):
    return sums_by_column(cells(t))


def sums_by_column(m):
    outs = [r(F.sum("v"), 5).alias("total"), r(F.stddev_pop("v")).alias("std")]
    return m.groupBy("j").agg(*outs).unionByName(m.agg(F.lit(-1).alias("j"), *outs))


@query("matrix_sums_all", "A20", f"""
SELECT j, ROUND(SUM(v), 5) AS total, ROUND(STDDEV_POP(v), 6) AS std FROM {_ALL_CELLS} GROUP BY j
UNION ALL SELECT -1, ROUND(SUM(v), 5), ROUND(STDDEV_POP(v), 6) FROM {_ALL_CELLS}""")
def matrix_sums_all(t):
    return sums_by_column(all_cells(t))


@query("weighted_mean", "A21", """
SELECT l_returnflag, ROUND(SUM(l_extendedprice * l_quantity) / SUM(l_quantity), 4) AS wmean FROM lineitem GROUP BY 1""")
def weighted_mean(t):
    return t.lineitem.groupBy("l_returnflag").agg(r(agg.weighted_mean(c("l_extendedprice"), c("l_quantity")), 4).alias("wmean"))


@query("reduce_sum", "A23", """
SELECT o_custkey, CAST(SUM(o_orderkey) AS BIGINT) AS total, MAX(o_totalprice) AS largest FROM orders GROUP BY 1""")
def reduce_sum(t):
    return t.orders.groupBy("o_custkey").agg(F.sum("o_orderkey").alias("total"), F.max("o_totalprice").alias("largest"))


@query("word_count", "A24", r"""
SELECT word, COUNT(*) AS n FROM (SELECT UNNEST(regexp_extract_all(text, '[^ \t\n\r\x{0b}\x0c]+')) AS word FROM conversations)
GROUP BY word ORDER BY n DESC, word LIMIT 25""")
def word_count(t):
    words = t.conversations.select(F.explode(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\x0b\x0c]+"), F.lit(0))).alias("word"))
    return sampling.top_rows(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), 25, c("n").desc(), c("word"))


@query("count_columns", "A25", f"SELECT COUNT(c_custkey) AS c_custkey, COUNT(a) AS a, COUNT(b) AS b, COUNT(s) AS s FROM {_SPARSE}")
def count_columns(t):
    return sparse(t).agg(*[F.count(x).alias(x) for x in ("c_custkey", "a", "b", "s")])


@query("group_estimator", "A26", "SELECT p_type, ROUND(AVG(p_retailprice), 6) AS mean, ROUND(STDDEV_POP(p_retailprice), 6) AS spread FROM part GROUP BY 1")
def group_estimator(t):
    return rounded(t.part.groupBy("p_type").agg(F.avg("p_retailprice").alias("mean"), F.stddev_pop("p_retailprice").alias("spread")))


@query("count_by_hue", "A27", "SELECT CAST(isodow(ts) - 1 AS INTEGER) AS weekday, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2")
def count_by_hue(t):
    return t.events.groupBy(F.weekday("ts").alias("weekday"), "event_type").agg(F.count(F.lit(1)).alias("n"))


_HIST = """SELECT {g} bin, ROUND(lo + (hi - lo) / {k} * bin, 4) AS left_edge, ROUND(lo + (hi - lo) / {k} * (bin + 1), 4) AS right_edge,
 COUNT(*) AS n FROM (SELECT *, CAST(LEAST(FLOOR((v - lo) / (hi - lo) * {k}), {k} - 1) AS INTEGER) AS bin FROM
 (SELECT {g} {v} AS v, MIN({v}) OVER ({p}) AS lo, MAX({v}) OVER ({p}) AS hi FROM {t})) GROUP BY {g} lo, hi, bin"""


@query("histogram", "A28", _HIST.format(g="", v="o_totalprice", p="", t="orders", k=30))
def histogram(t):
    return rounded(dist.histogram(t.orders, "o_totalprice", 30), 4)


@query("histogram_by", "A29", _HIST.format(g="o_orderstatus,", v="o_totalprice", p="PARTITION BY o_orderstatus", t="orders", k=10))
def histogram_by(t):
    return rounded(dist.histogram(t.orders, "o_totalprice", 10, ["o_orderstatus"]), 4)


@query("hist2d", "A30", """
SELECT CAST(LEAST(FLOOR((x - lx) / (hx - lx) * 20), 19) AS INTEGER) AS bx, CAST(LEAST(FLOOR((y - ly) / (hy - ly) * 20), 19) AS INTEGER) AS by, COUNT(*) AS n
FROM (SELECT x, y, MIN(x) OVER () lx, MAX(x) OVER () hx, MIN(y) OVER () ly, MAX(y) OVER () hy
 FROM (SELECT l_quantity x, l_extendedprice y FROM lineitem)) GROUP BY 1, 2""")
def hist2d(t):
    return dist.histogram2d(t.lineitem, "l_quantity", "l_extendedprice", (20, 20))


@query("hexbin", "A30", """
WITH g AS (SELECT (x - lx) / (hx - lx) * 25 AS u, (y - ly) / (hy - ly) * 14 AS v FROM
 (SELECT x, y, MIN(x) OVER () lx, MAX(x) OVER () hx, MIN(y) OVER () ly, MAX(y) OVER () hy
  FROM (SELECT o_totalprice x, CAST(o_custkey AS DOUBLE) y FROM orders))),
d AS (SELECT *, (u - FLOOR(u + 0.5))**2 + 3 * (v - FLOOR(v + 0.5))**2 AS d0,
 (u - FLOOR(u) - 0.5)**2 + 3 * (v - FLOOR(v) - 0.5)**2 AS d1 FROM g)
SELECT CASE WHEN d0 < d1 THEN 0 ELSE 1 END AS lattice, CAST(CASE WHEN d0 < d1 THEN FLOOR(u + 0.5) ELSE FLOOR(u) END AS BIGINT) AS hx,
 CAST(CASE WHEN d0 < d1 THEN FLOOR(v + 0.5) ELSE FLOOR(v) END AS BIGINT) AS hy, COUNT(*) AS n FROM d GROUP BY 1, 2, 3""")
def hexbin(t):
    return dist.hexbin(t.orders, "o_totalprice", "o_custkey", 25)


@query("kde", "A31", """
WITH s AS (SELECT MIN(c_acctbal) lo, MAX(c_acctbal) hi, COUNT(*) n,
 ((4 * STDDEV_POP(c_acctbal)**5) / (3 * COUNT(*)))**0.2 AS h FROM customer),
g AS (SELECT CAST(k AS INTEGER) AS k, lo + (hi - lo) * (k / 24.0::DOUBLE) AS x, n, h FROM s, range(0, 25) r(k))
SELECT k, ROUND(x, 4) AS x, ROUND(SUM(EXP(-0.5 * ((c_acctbal - x) / h)**2)) / (n * h * SQRT(2 * PI())), 12) AS density
FROM g, customer GROUP BY k, x, n, h""")
def kde(t):
    return rounded(dist.kernel_density(t.customer, "c_acctbal", 25), 4, density=12)


@query("boxplot", "A32", """
WITH q AS (SELECT l_returnflag, QUANTILE_CONT(l_extendedprice, 0.25) q1, QUANTILE_CONT(l_extendedprice, 0.5) med,
 QUANTILE_CONT(l_extendedprice, 0.75) q3 FROM lineitem GROUP BY 1),
w AS (SELECT l_returnflag, q1, med, q3, l_extendedprice v,
 l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM lineitem JOIN q USING (l_returnflag))
SELECT l_returnflag, ROUND(q1, 4) q1, ROUND(med, 4) med, ROUND(q3, 4) q3, MIN(v) FILTER (ok) AS whisker_low,
 MAX(v) FILTER (ok) AS whisker_high, COUNT(*) FILTER (NOT ok) AS n_outliers FROM w GROUP BY l_returnflag, q1, med, q3""")
def boxplot(t):
    return rounded(dist.boxplot(t.lineitem, "l_extendedprice", ["l_returnflag"]), 4)


@query("linear_fit_by", "A33", """
SELECT l_returnflag, ROUND(REGR_SLOPE(l_extendedprice, l_quantity), 4) AS slope, ROUND(REGR_INTERCEPT(l_extendedprice, l_quantity), 3) AS intercept,
 ROUND(REGR_R2(l_extendedprice, l_quantity), 6) AS r2, CAST(REGR_COUNT(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1""")
def linear_fit_by(t):
    return rounded(agg.linear_fit(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"]), 4, intercept=3, r2=6)


@query("table_profile", "A34", """
SELECT 'c_custkey' AS column_name, 'bigint' AS column_type, COUNT(c_custkey) AS non_null, COUNT(*) AS row_count FROM customer
UNION ALL SELECT 'c_mktsegment', 'string', COUNT(c_mktsegment), COUNT(*) FROM customer
UNION ALL SELECT 'a', 'double', COUNT(CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END), COUNT(*) FROM customer
UNION ALL SELECT 'b', 'int', COUNT(CASE WHEN c_custkey % 7 <> 0 THEN c_nationkey END), COUNT(*) FROM customer
UNION ALL SELECT 's', 'string', COUNT(CASE WHEN c_custkey % 35 <> 0 THEN c_mktsegment END), COUNT(*) FROM customer""")
def table_profile(t):
    return agg.table_profile(sparse(t))


@query("sparsity", "A35", """
WITH x AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem),
s AS (SELECT COUNT(*) AS nnz, COUNT(DISTINCT l_partkey) AS n_rows, COUNT(DISTINCT l_suppkey) AS n_cols FROM x)
SELECT *, ROUND(1 - nnz / (n_rows::DOUBLE * n_cols), 6) AS sparsity, ROUND(nnz / (n_rows::DOUBLE * n_cols) * 100, 6) AS percent_filled FROM s""")
def sparsity(t):
    return rounded(agg.sparsity(t.lineitem, "l_partkey", "l_suppkey"))


# --- windows, order, sampling ----------------------------------------------

_PANEL = """panel AS (SELECT o_orderstatus AS series, CAST(o_orderdate AS DATE) AS day, AVG(o_totalprice) AS close,
 MAX(o_totalprice) AS high, MIN(o_totalprice) AS low, SUM(o_totalprice) AS volume, COUNT(*) AS n FROM orders GROUP BY 1, 2)"""


def panel(t):
    return windows.daily_panel(t.orders, "o_orderstatus", "o_orderdate", "o_totalprice")


@query("pct_change", "W1", f"""
WITH {_PANEL} SELECT series, CAST(day AS VARCHAR) AS day,
 ROUND(close / LAG(close) OVER (PARTITION BY series ORDER BY day) - 1, 6) + 0.0 AS change FROM panel""")
def pct_change(t):
    out = windows.pct_change(panel(t), "series", "day", "close")
    return out.select("series", c("day").cast("string").alias("day"), r(c("change")).alias("change"))


@query("rolling_mean", "W2", f"""
WITH {_PANEL} SELECT series, CAST(day AS VARCHAR) AS day, ROUND(CASE WHEN COUNT(high) OVER w = 30 THEN AVG(high) OVER w END, 5) AS mean30
FROM panel WHERE day BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'
WINDOW w AS (PARTITION BY series ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def rolling_mean(t):
    year = panel(t).where(c("day").between(F.lit("1997-01-01").cast("date"), F.lit("1997-12-31").cast("date")))
    out = windows.rolling_means(year, "series", "day", "high", {"mean30": 30})
    return out.select("series", c("day").cast("string").alias("day"), r(c("mean30"), 5).alias("mean30"))


@query("sma_multi", "W3", f"""
WITH {_PANEL} SELECT series, CAST(day AS VARCHAR) AS day, """ + ", ".join(
    f"""ROUND(CASE WHEN COUNT(high) OVER w{k} = {k} THEN AVG(high) OVER w{k} END, 5) AS sma{k}""" for k in (13, 21, 55))
    + " FROM panel WINDOW " + ", ".join(
    f"w{k} AS (PARTITION BY series ORDER BY day ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)" for k in (13, 21, 55)))
def sma_multi(t):
    out = windows.rolling_means(panel(t), "series", "day", "high", {f"sma{k}": k for k in (13, 21, 55)})
    return rounded(out.select("series", c("day").cast("string").alias("day"), "sma13", "sma21", "sma55"), 5)


@query("bollinger", "W4", f"""
WITH {_PANEL}, b AS (SELECT series, day, CASE WHEN COUNT(high) OVER w = 20 THEN AVG(high) OVER w END AS mid,
 CASE WHEN COUNT(high) OVER w = 20 THEN STDDEV(high) OVER w END AS dev FROM panel
 WINDOW w AS (PARTITION BY series ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT series, CAST(day AS VARCHAR) AS day, ROUND(mid, 5) AS mid, ROUND(mid + 2 * dev, 5) AS upper, ROUND(mid - 2 * dev, 5) AS lower FROM b""")
def bollinger(t):
    out = windows.bollinger(panel(t), "series", "day", "high")
    return rounded(out.select("series", c("day").cast("string").alias("day"), "mid", "upper", "lower"), 5)


@query("enumerate", "W6", """
SELECT event_id, value, ROW_NUMBER() OVER (ORDER BY value, event_id) + 100 AS pos FROM events""")
def enumerate_rows(t):
    numbered = ranking.with_row_number(t.events.select("event_id", "value"), "value", tie="event_id", out="pos")
    return numbered.withColumn("pos", c("pos") + 100)


@query("nth_row", "W7, O3", "SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 1 OFFSET 3")
def nth_row(t):
    return sampling.nth_row(t.documents.select("doc_id", "n_chars"), "doc_id", 3)


@query("sort_rows", "O1", f"SELECT c_custkey, a FROM {_SPARSE} ORDER BY a DESC NULLS FIRST")
def sort_rows(t):
    return sampling.sort_sql(sparse(t).select("c_custkey", "a"), "a", ascending=False)


@query("top_k", "O2, O3", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5")
def top_k(t):
    return sampling.top_rows(t.orders.select("o_orderkey", "o_totalprice"), 5, c("o_totalprice").desc(), c("o_orderkey"))


@query("top_n", "O4", "SELECT l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC LIMIT 10")
def top_n(t):
    return sampling.top_rows(t.lineitem.select("l_extendedprice"), 10, c("l_extendedprice").desc())


@query("sort_by_key", "O5", "SELECT p_name, SUM(p_retailprice) AS total FROM part GROUP BY 1".replace(
    "SUM(p_retailprice)", "ROUND(SUM(p_retailprice), 4)"))
def sort_by_key(t):
    sums = t.part.groupBy("p_name").agg(r(F.sum("p_retailprice"), 4).alias("total"))
    return sums.orderBy(c("total").desc())


@query("random_top_n", "O6", """
SELECT o_orderkey, (o_orderkey % 2147483648 * 1103515245 + 12345) % 2147483648 AS random_index FROM orders
ORDER BY random_index, o_orderkey LIMIT 1000""")
def random_top_n(t):
    return sampling.random_top(t.orders.select("o_orderkey"), "o_orderkey", 1000)


@query("sample_rows", "O7")
def sample_rows(t):
    keys = t.orders.select("o_orderkey")
    return (sampling.sample_fraction(keys, 0.1, "o_orderkey", 7).withColumn("kind", F.lit("fraction"))
            .unionByName(sampling.sample_exact(keys, 50, "o_orderkey", 7).withColumn("kind", F.lit("exact")))
            .unionByName(sampling.sample_replaced(keys, 0.05, "o_orderkey", 7).withColumn("kind", F.lit("replacement"))))


@query("shuffle_rows", "O8", "SELECT o_orderkey, o_custkey FROM orders")
def shuffle_rows(t):
    return sampling.shuffle_rows(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey")


_HASHED = "CAST(('0x' || substr(md5('{}|' || c_custkey), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE"


@query("random_columns", "O9", f"""
SELECT c_custkey, ROUND({_HASHED.format(42)}, 9) AS uniform,
 ROUND(SQRT(-2 * LN(1 - {_HASHED.format(42)})) * COS(2 * PI() * {_HASHED.format(1000045)}), 6) + 0.0 AS normal,
 CAST(FLOOR({_HASHED.format(7)} * 100) AS BIGINT) AS whole FROM customer""")
def random_columns(t):
    return t.customer.select("c_custkey", F.round(sampling.key_uniform("c_custkey", 42), 9).alias("uniform"),
                             (F.round(sampling.key_normal("c_custkey", 42), 6) + 0.0).alias("normal"),
                             F.floor(sampling.key_uniform("c_custkey", 7) * 100).alias("whole"))


@query("ranges", "O10", """
SELECT n_nationkey, UNNEST(range(0, 10 * (n_nationkey + 1), 5))::BIGINT AS arange_value,
 UNNEST(list_transform(range(0, 2 * (n_nationkey + 1)), lambda i: i / (2 * (n_nationkey + 1) - 1)::DOUBLE)) AS linspace_value FROM nation""")
def ranges(t):
    n = 2 * (c("n_nationkey") + 1)
    steps = F.posexplode(F.sequence(F.lit(0), n - 1))
    return t.nation.select("n_nationkey", steps.alias("i", "k")).select(
        "n_nationkey", (c("k").cast("bigint") * 5).alias("arange_value"),
        (c("k") / (2 * (c("n_nationkey") + 1) - 1)).alias("linspace_value"))


# --- series ----------------------------------------------------------------

_FREQ = [k / 365 for k in range(1, 13)]


@query("periodogram", "T1, T2", f"""
WITH {_PANEL}, y AS (SELECT series, DATE_DIFF('day', DATE '1995-01-01', day) AS d,
  close + 50000 * SIN(2 * PI() * 4 / 365.0::DOUBLE * DATE_DIFF('day', DATE '1995-01-01', day)) AS y FROM panel),
m AS (SELECT series, d, y - AVG(y) OVER (PARTITION BY series) AS y FROM y),
f AS (SELECT k / 365.0::DOUBLE AS frequency FROM range(1, 13) r(k))
SELECT series, ROUND(frequency, 9) AS frequency, ROUND(SQRT(SUM(y * COS(2 * PI() * frequency * d))**2 + SUM(y * SIN(2 * PI() * frequency * d))**2), 1) AS amplitude
FROM m, f GROUP BY series, frequency""")
def periodogram(t):
    out = series.periodogram(signal(t), "series", "d", "y", _FREQ)
    return rounded(out, 1, frequency=9)


def signal(t):
    d = F.datediff("day", F.lit("1995-01-01").cast("date")).cast("double")
    return panel(t).select("series", d.alias("d"), (c("close") + series.sinusoids(d, [(50000.0, 4 / 365, 0.0)])).alias("y"))


@query("periodogram_full", "T1, T2", f"""
WITH {_PANEL}, y AS (SELECT series, DATE_DIFF('day', DATE '1995-01-01', day) AS d,
  close + 50000 * SIN(2 * PI() * 4 / 365.0::DOUBLE * DATE_DIFF('day', DATE '1995-01-01', day)) AS y FROM panel),
m AS (SELECT series, d - MIN(d) OVER (PARTITION BY series) AS d, y - AVG(y) OVER (PARTITION BY series) AS y FROM y),
n AS (SELECT series, MAX(d) + 1 AS n FROM m GROUP BY series), f AS (SELECT series, n, UNNEST(range(0, n // 2 + 1)) AS k FROM n),
h AS (SELECT series, n, k, SQRT(SUM(y * COS(2 * PI() * ((k * d) % n) / n))**2 + SUM(y * SIN(2 * PI() * ((k * d) % n) / n))**2) AS a
 FROM m JOIN f USING (series) GROUP BY ALL), s AS (SELECT UNNEST([-1, 1]) AS s)
SELECT series, ROUND(s * k / n::DOUBLE, 9) + 0.0 AS frequency, ROUND(a, 1) AS amplitude FROM h JOIN s ON (k > 0 OR s = 1) AND (2 * k <> n OR s = -1)""")
def periodogram_full(t):
    return rounded(series.spectrum(signal(t), "series", "d", "y", 1.0), 1, frequency=9)


@query("series_max", "T3", "SELECT o_orderstatus AS series, MAX(o_totalprice) AS high FROM orders GROUP BY 1")
def series_max(t):
    return t.orders.groupBy(c("o_orderstatus").alias("series")).agg(F.max("o_totalprice").alias("high"))


@query("series_volatility", "T4", f"""
WITH {_PANEL}, ch AS (SELECT series, year(day) AS yr, close / LAG(close) OVER (PARTITION BY series ORDER BY day) - 1 AS change FROM panel)
SELECT series, CAST(NULL AS INTEGER) AS yr, ROUND(STDDEV(change), 6) AS volatility FROM ch GROUP BY series
UNION ALL SELECT series, CAST(yr AS INTEGER), ROUND(STDDEV(change), 6) FROM ch GROUP BY series, yr""")
def series_volatility(t):
    ch = windows.pct_change(panel(t), "series", "day", "close")
    total = series.volatility(ch, "series", "change").select("series", F.lit(None).cast("int").alias("yr"), "volatility")
    yearly = series.volatility(ch, "series", "change", [F.year("day").alias("yr")])
    return rounded(total.unionByName(yearly))


@query("daily_counts", "T5", """
WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, CAST(day AS VARCHAR) AS day, n, ROUND(REGR_SLOPE(n, DATE_DIFF('day', DATE '2024-01-01', day)) OVER (PARTITION BY event_type), 6) + 0.0 AS trend FROM d""")
def daily_counts(t):
    d = t.events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    x = d.withColumn("x", F.datediff("day", F.lit("2024-01-01").cast("date")))
    fit = agg.linear_fit(x, "x", "n", ["event_type"]).select("event_type", r(c("slope")).alias("trend"))
    return d.join(fit, "event_type").select("event_type", c("day").cast("string").alias("day"), "n", "trend")


@query("monthly_counts", "T5", """
WITH m AS (SELECT CAST(month(o_orderdate) AS INTEGER) AS month, o_orderstatus AS reason, COUNT(*) AS n FROM orders GROUP BY 1, 2)
SELECT reason, month, n, ROUND(REGR_SLOPE(n, month) OVER (PARTITION BY reason), 6) + 0.0 AS trend FROM m""")
def monthly_counts(t):
    m = t.orders.groupBy(F.month("o_orderdate").alias("month"), c("o_orderstatus").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    fit = agg.linear_fit(m, "month", "n", ["reason"]).select("reason", r(c("slope")).alias("trend"))
    return m.join(fit, "reason").select("reason", "month", "n", "trend")


@query("line_residual", "T6", """
SELECT event_id, ROUND(value - (12.6 + 3.24 * LOG10(1 + user_id)), 6) AS residual FROM events""")
def line_residual(t):
    return t.events.select("event_id", r(series.nova_residual(F.log10(1 + c("user_id")), c("value"))).alias("residual"))
