"""DDL/DML checks, projection, filters, missing data, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumentab.operators import guarded, integrity, joins, missing, relational as rel, setops
from lumentab.plans.registry import query
from lumentab.session import scratch_path

c = F.col


# --- flagship -------------------------------------------------------------

@query("flagship", "A5", """
SELECT c_custkey, c_acctbal, COUNT(o_orderkey) AS n_orders
FROM customer JOIN orders ON c_custkey = o_custkey
WHERE c_acctbal > 1000 GROUP BY c_custkey, c_acctbal
HAVING COUNT(o_orderkey) > 1 ORDER BY c_acctbal DESC""")
def flagship(t):
    # counting before the join: a hot customer crosses the network once per task
    per_customer = (
        t.orders.where(c("o_orderkey").isNotNull())
        .groupBy("o_custkey").agg(F.count("o_orderkey").alias("n_orders"))
        .where(c("n_orders") > 1)
    )
    return (
        t.customer.where(c("c_acctbal") > 1000)
        .join(per_customer, c("c_custkey") == c("o_custkey"))
        .select("c_custkey", "c_acctbal", "n_orders")
        .orderBy(c("c_acctbal").desc())
    )


# --- DDL / DML / integrity -------------------------------------------------

STAR_DDL = "star_id BIGINT NOT NULL, balance DOUBLE, segment VARCHAR(20)"


@query("ddl_create", "D1, K4, S9",
       "SELECT c_custkey AS star_id, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def ddl_create(t):
    path = scratch_path(t.spark, "ddl")
    name = "ddl_" + path.rsplit("-", 1)[1]
    t.spark.sql(f"CREATE TABLE {name} ({STAR_DDL}) USING parquet LOCATION '{path}'")
    rows = t.customer.select(c("c_custkey").alias("star_id"), c("c_acctbal").alias("balance"),
                             c("c_mktsegment").alias("segment"))
    rows.write.insertInto(name)
    return t.spark.table(name)


@query("check_not_null", "D2", """
SELECT 'c_custkey' AS column_name, COUNT(*) FILTER (c_custkey IS NULL) AS violations FROM customer
UNION ALL
SELECT 'balance', COUNT(*) FILTER ((CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END) IS NULL) FROM customer""")
def check_not_null(t):
    df = t.customer.withColumn("balance", F.when(c("c_custkey") % 5 != 0, c("c_acctbal")))
    return integrity.not_null_violations(df, ["c_custkey", "balance"])


@query("check_unique", "D3", """
SELECT l_orderkey, l_linenumber, COUNT(*) AS copies FROM lineitem
GROUP BY ALL HAVING COUNT(*) > 1""")
def check_unique(t):
    return integrity.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("check_predicate", "D4", """
SELECT c_custkey, c_acctbal FROM customer
WHERE NOT (CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END > 3000)""")
def check_predicate(t):
    balance = F.when(c("c_custkey") % 5 != 0, c("c_acctbal"))
    return integrity.check_violations(t.customer, balance > 3000).select("c_custkey", "c_acctbal")


@query("check_foreign_key", "D5", """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_custkey IS NOT NULL AND NOT EXISTS
 (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)""")
def check_foreign_key(t):
    parents = t.customer.where(c("c_acctbal") > 0)
    return integrity.foreign_key_violations(t.orders, "o_custkey", parents, "c_custkey").select(
        "o_orderkey", "o_custkey")


@query("dml_insert", "D6, U1", """
SELECT c_custkey, c_name, c_acctbal FROM customer
UNION ALL SELECT s_suppkey + 1000000000, NULL, s_acctbal FROM supplier""")
def dml_insert(t):
    extra = t.supplier.select((c("s_suppkey") + 1_000_000_000).alias("c_custkey"),
                              c("s_acctbal").alias("c_acctbal"))
    return integrity.insert_rows(t.customer.select("c_custkey", "c_name", "c_acctbal"), extra)


@query("dml_update", "D7", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def dml_update(t):
    return integrity.update_where(
        t.customer.select("c_custkey", "c_acctbal", "c_mktsegment"),
        c("c_acctbal") < 0, {"c_mktsegment": F.lit(None).cast("string")}).drop("c_acctbal")


@query("dml_delete", "D8", """
SELECT c_custkey, balance FROM
 (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS balance FROM customer)
WHERE NOT COALESCE(balance > 5000, FALSE)""")
def dml_delete(t):
    df = t.customer.select("c_custkey", F.when(c("c_custkey") % 5 != 0, c("c_acctbal")).alias("balance"))
    return integrity.delete_where(df, c("balance") > 5000)


@query("dml_set_cell", "D9", """
SELECT c_custkey, CASE WHEN c_custkey = 95 THEN 100.0::DOUBLE ELSE c_acctbal END AS c_acctbal FROM customer""")
def dml_set_cell(t):
    return integrity.set_cell(t.customer.select("c_custkey", "c_acctbal"), "c_custkey", 95, "c_acctbal", 100.0)


_STARS = "SELECT c_custkey AS star_id, c_acctbal AS balance, c_mktsegment AS segment FROM customer"


def stars(t):
    return t.customer.select(c("c_custkey").alias("star_id"), c("c_acctbal").alias("balance"), c("c_mktsegment").alias("segment"))


def guarded_stars(t):
    """A table of stars whose key, balance and orders are guarded."""
    rules = guarded.Constraints(
        not_null=["star_id"], unique=[["star_id"]], checks={"balance": c("balance") > -100_000},
        children={"orders": guarded.Child(t.orders, ["o_custkey"], ["star_id"])})
    return guarded.GuardedTable(t.spark, scratch_path(t.spark, "guarded"), rules)


def refused(write, *args):
    """Broken constraints of a write that must fail, as one string."""
    try:
        write(*args)
    except guarded.ConstraintError as e:
        return str(e)
    return "accepted"


@query("guarded_insert", "D2, D3, D4, D6", f"""
SELECT *, (SELECT 'check balance: ' || COUNT(*) || ', unique star_id: ' || COUNT(*) FROM customer) AS refused
FROM ({_STARS} UNION ALL SELECT s_suppkey + 1000000000, s_acctbal, NULL FROM supplier)""")
def guarded_insert(t):
    table = guarded_stars(t).create(stars(t))
    table.insert(t.supplier.select((c("s_suppkey") + 1_000_000_000).alias("star_id"), c("s_acctbal").alias("balance")))
    why = refused(table.insert, stars(t).withColumn("balance", F.lit(-200_000.0)))
    return table.read().withColumn("refused", F.lit(why))


@query("guarded_update", "D2, D7", f"""
SELECT star_id, balance, CASE WHEN balance < 0 THEN NULL ELSE segment END AS segment,
 (SELECT 'not null star_id: ' || COUNT(*) FROM customer WHERE c_custkey % 3 = 0) AS refused FROM ({_STARS})""")
def guarded_update(t):
    table = guarded_stars(t).create(stars(t))
    table.update(c("balance") < 0, {"segment": F.lit(None).cast("string")})
    why = refused(table.insert, stars(t).where(c("star_id") % 3 == 0).withColumn("star_id", F.lit(None).cast("bigint")))
    return table.read().withColumn("refused", F.lit(why))


@query("guarded_delete", "D5, D8", f"""
SELECT *, (SELECT 'child orders: ' || COUNT(*) FROM orders WHERE o_custkey IS NOT NULL) AS refused FROM ({_STARS})
WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = star_id) OR star_id % 2 = 0""")
def guarded_delete(t):
    table = guarded_stars(t).create(stars(t))
    used = t.orders.select(c("o_custkey").alias("used")).distinct()
    kept = stars(t).join(used, c("star_id") == c("used"), "left").where(c("used").isNotNull() | (c("star_id") % 2 == 0)).drop("used")
    table.replace(kept)
    why = refused(table.delete, c("star_id").isNotNull())
    return table.read().withColumn("refused", F.lit(why))


# --- projection and filters ------------------------------------------------

@query("project", "F1", "SELECT o_orderkey, o_totalprice FROM orders")
def project(t):
    return t.orders.select("o_orderkey", "o_totalprice")


@query("computed_column", "F2", """
SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net,
       LENGTH(l_returnflag || l_linestatus) AS flag_len FROM lineitem""")
def computed_column(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber",
        (c("l_extendedprice") * (1 - c("l_discount"))).alias("net"),
        F.length(F.concat("l_returnflag", "l_linestatus")).cast("bigint").alias("flag_len"))


@query("drop_column", "F3", "SELECT * EXCLUDE (c_name, c_mktsegment) FROM customer")
def drop_column(t):
    return t.customer.drop("c_name", "c_mktsegment")


@query("rename", "F4", "SELECT r_regionkey AS id, r_name AS label FROM region")
def rename(t):
    return t.region.toDF("id", "label")


@query("filter_cmp", "F5", """
SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 200000
 AND o_orderstatus <> 'F' AND o_custkey <= 1000000 AND o_orderkey > 0""")
def filter_cmp(t):
    return t.orders.where(
        (c("o_totalprice") >= 1000) & (c("o_totalprice") < 200000) & (c("o_orderstatus") != "F")
        & (c("o_custkey") <= 1_000_000) & (c("o_orderkey") > 0)).select("o_orderkey")


@query("filter_between", "F6", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 5000 AND 6000")
def filter_between(t):
    return t.customer.where(c("c_acctbal").between(5000, 6000)).select("c_custkey", "c_acctbal")


_SPARSE = """(SELECT c_custkey, c_mktsegment,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS a,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END AS b,
  CASE WHEN c_custkey % 35 = 0 THEN NULL ELSE c_mktsegment END AS s FROM customer)"""


def sparse(t):
    """Customers with holes, the input of the missing-data queries."""
    return t.customer.select(
        "c_custkey", "c_mktsegment",
        F.when(c("c_custkey") % 5 != 0, c("c_acctbal")).alias("a"),
        F.when(c("c_custkey") % 7 != 0, c("c_nationkey")).alias("b"),
        F.when(c("c_custkey") % 35 != 0, c("c_mktsegment")).alias("s"))


@query("filter_null", "F7", f"SELECT c_custkey, a IS NULL AS a_missing FROM {_SPARSE} WHERE a IS NULL OR b IS NOT NULL")
def filter_null(t):
    return sparse(t).where(c("a").isNull() | c("b").isNotNull()).select(
        "c_custkey", c("a").isNull().alias("a_missing"))


@query("filter_bool", "F8", """
SELECT c_custkey FROM customer
WHERE (c_acctbal > 5000 AND c_mktsegment = 'BUILDING') OR (c_acctbal < 0 AND NOT c_nationkey = 3)""")
def filter_bool(t):
    return t.customer.where(
        ((c("c_acctbal") > 5000) & (c("c_mktsegment") == "BUILDING"))
        | ((c("c_acctbal") < 0) & ~(c("c_nationkey") == 3))).select("c_custkey")


@query("mask_elementwise", "F9", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN l_discount END AS l_discount,
 CASE WHEN l_tax > 0 THEN l_tax END AS l_tax FROM lineitem""")
def mask_elementwise(t):
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return rel.mask_elementwise(df, ["l_discount", "l_tax"], lambda x: x > 0)


@query("filter_project", "F10", "SELECT p_name, p_retailprice FROM part WHERE p_size > 25 AND p_type = 'ECONOMY'")
def filter_project(t):
    return t.part.where(c("p_size") > 25).where(c("p_type") == "ECONOMY").select("p_name", "p_retailprice")


@query("loc_rows", "F11", "SELECT n_name, n_regionkey FROM nation WHERE n_nationkey IN (1, 4, 7)")
def loc_rows(t):
    return rel.rows_by_label(t.nation, "n_nationkey", [1, 4, 7], ["n_name", "n_regionkey"])


@query("iloc_rows", "F12", """
SELECT o_orderkey, pos FROM (SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)
WHERE pos >= 100 AND pos < 120""")
def iloc_rows(t):
    return rel.rows_by_position(t.orders.select("o_orderkey"), "o_orderkey", 100, 120)


@query("drop_rows", "F13", "SELECT n_nationkey, n_name FROM nation WHERE n_name <> 'NATION_3'")
def drop_rows(t):
    return rel.drop_label(t.nation, "n_name", "NATION_3").select("n_nationkey", "n_name")


@query("reset_index", "F14", """
SELECT c_custkey, c_acctbal, ROW_NUMBER() OVER (ORDER BY c_acctbal, c_custkey) - 1 AS index FROM customer""")
def reset_index(t):
    return rel.reset_index(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", tie="c_custkey")


@query("cross_section", "F15", """
SELECT c_nationkey, COUNT(*) AS n FROM customer WHERE c_mktsegment = 'MACHINERY' GROUP BY c_nationkey""")
def cross_section(t):
    panel = t.customer.groupBy("c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return rel.cross_section(panel, "c_mktsegment", "MACHINERY")


@query("date_slice", "F16", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'""")
def date_slice(t):
    return rel.date_slice(t.orders, "o_orderdate", "1996-01-01", "1996-12-31").select("o_orderkey", "o_totalprice")


_CELLS = """(SELECT vec_id AS i, CAST(j AS INTEGER) AS j, CAST(embedding[j + 1] AS DOUBLE) AS v
  FROM embeddings, range(0, 8) r(j))"""


def cells(t):
    return rel.long_matrix(t.embeddings, "vec_id", [F.get("embedding", F.lit(k)).cast("double") for k in range(8)])


@query("submatrix", "F17", f"""
SELECT i, j, v, CAST(-1 AS INTEGER) AS pos FROM {_CELLS} WHERE i < 2 AND j >= 1 AND j < 8
UNION ALL SELECT i, j, v, CASE i WHEN 6 THEN 0 WHEN 4 THEN 1 WHEN 2 THEN 2 ELSE 3 END FROM {_CELLS} WHERE i IN (6, 4, 2, 7)""")
def submatrix(t):
    m = cells(t)
    block = rel.submatrix(m, (0, 2), (1, 8)).withColumn("pos", F.lit(-1))
    return block.unionByName(rel.pick_rows(m, [6, 4, 2, 7]).withColumn("pos", c("pos").cast("int")))


# the same three jobs over all elements of every vector, whatever its length; the twins above stay as they were given
_ALL_CELLS = "(SELECT vec_id AS i, CAST(j - 1 AS INTEGER) AS j, CAST(embedding[j] AS DOUBLE) AS v FROM (SELECT *, UNNEST(range(1, LEN(embedding) + 1)) AS j FROM embeddings))"


def all_cells(t):
    return t.embeddings.select(c("vec_id").alias("i"), F.posexplode(F.transform("embedding", lambda x: x.cast("double"))).alias("j", "v"))


@query("submatrix_all", "F17", f"""
SELECT i, j, v, CAST(-1 AS INTEGER) AS pos FROM {_ALL_CELLS} WHERE i < 2 AND j >= 1
UNION ALL SELECT i, j, v, CASE i WHEN 6 THEN 0 WHEN 4 THEN 1 WHEN 2 THEN 2 ELSE 3 END FROM {_ALL_CELLS} WHERE i IN (6, 4, 2, 7)""")
def submatrix_all(t):
    m = all_cells(t)
    block = rel.submatrix(m, (0, 2), (1, None)).withColumn("pos", F.lit(-1))
    return block.unionByName(rel.pick_rows(m, [6, 4, 2, 7]).withColumn("pos", c("pos").cast("int")))


@query("cast", "F18", """
SELECT o_orderkey, CAST(FLOOR(o_totalprice) AS INTEGER) AS whole,
 TRY_CAST(SUBSTR(o_orderpriority, 1, 1) AS INTEGER) AS rank, TRY_CAST(o_orderstatus AS DOUBLE) AS not_a_number FROM orders""")
def cast(t):
    return t.orders.select(
        "o_orderkey", F.floor("o_totalprice").cast("int").alias("whole"),
        F.substring("o_orderpriority", 1, 1).try_cast("int").alias("rank"),
        c("o_orderstatus").try_cast("double").alias("not_a_number"))


@query("const_column", "F19", "SELECT s_suppkey, 8.178 AS sun_kpc, 'pc' AS unit FROM supplier".replace("8.178", "CAST(8.178 AS DOUBLE)"))
def const_column(t):
    return t.supplier.select("s_suppkey").withColumns({"sun_kpc": F.lit(8.178), "unit": F.lit("pc")})


@query("map_codes", "F20", """
SELECT event_id, CASE isodow(ts) - 1 WHEN 0 THEN 'Mon' WHEN 1 THEN 'Tue' WHEN 2 THEN 'Wed'
 WHEN 3 THEN 'Thu' WHEN 4 THEN 'Fri' END AS day FROM events""")
def map_codes(t):
    names = {0: "Mon", 1: "Tue", 2: "Wed", 3: "Thu", 4: "Fri"}  # weekend left unmapped on purpose
    return t.events.select("event_id", rel.map_codes(F.weekday("ts"), names).alias("day"))


@query("dummies", "F21", """
SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS "seg_BUILDING",
 CASE WHEN c_mktsegment = 'FURNITURE' THEN 1 ELSE 0 END AS "seg_FURNITURE",
 CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1 ELSE 0 END AS "seg_HOUSEHOLD",
 CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS "seg_MACHINERY" FROM customer""")
def dummies(t):
    return rel.dummies(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", prefix="seg_").drop("c_mktsegment")


@query("recode", "F22", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned FROM lineitem")
def recode(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", rel.recode(c("l_returnflag"), "R").alias("returned"))


@query("split_by_class", "F23", """
SELECT label = 0 AS is_class0, COUNT(*) AS n, MIN(vec_id) AS first_id FROM embeddings GROUP BY label = 0""")
def split_by_class(t):
    e = t.embeddings.select("vec_id", "label")
    zero, rest = e.where(c("label") == 0), e.where(c("label") != 0)
    counts = [F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id")]
    return zero.agg(F.lit(True).alias("is_class0"), *counts).unionByName(
        rest.agg(F.lit(False).alias("is_class0"), *counts))


@query("angle_wrap", "F24", """
SELECT c_custkey, CASE WHEN ra > 180 THEN ra - 360 ELSE ra END AS ra_wrapped, (ra + 180) % 360 AS ra_turned
FROM (SELECT c_custkey, (c_custkey * 137.5::DOUBLE) % 360 AS ra FROM customer)""")
def angle_wrap(t):
    ra = F.pmod(c("c_custkey") * F.lit(137.5), F.lit(360.0))
    return t.customer.select("c_custkey", rel.wrap_degrees(ra).alias("ra_wrapped"),
                             F.pmod(ra + 180, F.lit(360.0)).alias("ra_turned"))


@query("case_buckets", "F25", """
SELECT o_orderkey, CASE WHEN v > 80 THEN 'big' WHEN v > 60 THEN 'small' ELSE 'none' END AS ticket
FROM (SELECT o_orderkey, o_totalprice / 5000 - CASE WHEN o_orderstatus = 'F' THEN 5 ELSE 0 END AS v FROM orders)""")
def case_buckets(t):
    label = rel.threshold_labels(c("o_totalprice") / 5000, [(80, "big"), (60, "small")], "none",
                                 flag=c("o_orderstatus") == "F", allowance=5)
    return t.orders.select("o_orderkey", label.alias("ticket"))


# --- missing data ----------------------------------------------------------

@query("dropna_any", "N1", f"SELECT c_custkey, a, b, s FROM {_SPARSE} WHERE a IS NOT NULL AND b IS NOT NULL AND s IS NOT NULL")
def dropna_any(t):
    return missing.drop_missing(sparse(t)).drop("c_mktsegment")


@query("dropna_subset", "N2", f"""
SELECT COUNT(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS rows_kept,
 COUNT(*) FILTER (NOT (a IS NOT NULL AND b IS NOT NULL)) AS rows_removed FROM {_SPARSE}""")
def dropna_subset(t):
    return missing.removal_report(sparse(t), ["a", "b"])


@query("dropna_columns", "N3", f"SELECT c_custkey, c_mktsegment FROM {_SPARSE}")
def dropna_columns(t):
    return missing.drop_missing_columns(sparse(t))


@query("dropna_thresh", "N4", f"""
SELECT c_custkey, a, b, s FROM {_SPARSE}
WHERE 2 + (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (s IS NOT NULL)::INT >= 4""")
def dropna_thresh(t):
    return missing.keep_with_at_least(sparse(t), 4).drop("c_mktsegment")


@query("fillna_const", "N5", f"SELECT c_custkey, COALESCE(a, 0.0::DOUBLE) AS a, COALESCE(b, -1) AS b, COALESCE(s, 'FILL') AS s FROM {_SPARSE}")
def fillna_const(t):
    return sparse(t).drop("c_mktsegment").na.fill({"a": 0.0, "b": -1, "s": "FILL"})


@query("fillna_mean", "N6", f"SELECT c_custkey, ROUND(COALESCE(a, AVG(a) OVER ()), 4) AS a FROM {_SPARSE}")
def fillna_mean(t):
    return missing.fill_with_mean(sparse(t), ["a"]).select("c_custkey", F.round("a", 4).alias("a"))


@query("fillna_group", "N7", f"""
SELECT c_custkey, ROUND(COALESCE(a, AVG(a) OVER (PARTITION BY c_mktsegment)), 4) AS by_mean,
 CASE WHEN a IS NOT NULL THEN a WHEN c_mktsegment = 'BUILDING' THEN 37 WHEN c_mktsegment = 'MACHINERY' THEN 29 ELSE 24 END AS by_rule
FROM {_SPARSE}""")
def fillna_group(t):
    filled = missing.fill_with_group_mean(sparse(t).withColumn("a0", c("a")), "a", "c_mktsegment")
    rule = (F.when(c("a0").isNotNull(), c("a0")).when(c("c_mktsegment") == "BUILDING", 37.0)
            .when(c("c_mktsegment") == "MACHINERY", 29.0).otherwise(24.0))
    return filled.select("c_custkey", F.round("a", 4).alias("by_mean"), rule.alias("by_rule"))


@query("null_profile", "N8", f"""
SELECT 'a' AS column_name, ROUND(AVG((a IS NULL)::INT), 6) AS null_rate FROM {_SPARSE}
UNION ALL SELECT 'b', ROUND(AVG((b IS NULL)::INT), 6) FROM {_SPARSE}
UNION ALL SELECT 's', ROUND(AVG((s IS NULL)::INT), 6) FROM {_SPARSE}""")
def null_profile(t):
    return missing.null_profile(sparse(t), ["a", "b", "s"]).withColumn("null_rate", F.round("null_rate", 6))


# --- joins -----------------------------------------------------------------

@query("join_inner", "J1", """
SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey""")
def join_inner(t):
    return t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).select("o_orderkey", "c_name")


@query("join_comma", "J2, S9", "SELECT s.s_suppkey, n.n_name FROM supplier s, nation n WHERE s.s_nationkey = n.n_nationkey")
def join_comma(t):
    return t.spark.sql(
        "SELECT s.s_suppkey, n.n_name FROM {supplier} AS s, {nation} AS n WHERE s.s_nationkey = n.n_nationkey",
        supplier=t.supplier, nation=t.nation)


@query("join_multi_key", "J3", """
SELECT a.l_orderkey, a.l_suppkey, a.n_lines, b.qty FROM
 (SELECT l_orderkey, l_suppkey, COUNT(*) AS n_lines FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL) a
 JOIN (SELECT l_orderkey, l_suppkey, SUM(l_quantity) AS qty FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) b
 ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey""")
def join_multi_key(t):
    keys = ["l_orderkey", "l_suppkey"]
    a = t.lineitem.where(c("l_returnflag") == "A").groupBy(keys).agg(F.count(F.lit(1)).alias("n_lines"))
    b = t.lineitem.where(c("l_returnflag") == "R").groupBy(keys).agg(F.sum("l_quantity").alias("qty"))
    return a.join(b, keys)


_SIDES = """(SELECT c_custkey AS k, c_acctbal AS lv FROM customer WHERE c_acctbal > 3000) a {how} JOIN
 (SELECT o_custkey AS k, COUNT(*) AS rv FROM orders WHERE o_totalprice > 250000 GROUP BY o_custkey) b USING (k)"""


def _sides(t):
    left = t.customer.where(c("c_acctbal") > 3000).select(c("c_custkey").alias("k"), c("c_acctbal").alias("lv"))
    right = (t.orders.where(c("o_totalprice") > 250000)
             .groupBy(c("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("rv")))
    return left, right


@query("join_left", "J4", "SELECT k, lv, rv FROM " + _SIDES.format(how="LEFT"))
def join_left(t):
    left, right = _sides(t)
    return left.join(right, "k", "left")


@query("join_right", "J4", "SELECT k, lv, rv FROM " + _SIDES.format(how="RIGHT"))
def join_right(t):
    left, right = _sides(t)
    return left.join(right, "k", "right")


@query("join_full", "J4", "SELECT k, lv, rv FROM " + _SIDES.format(how="FULL"))
def join_full(t):
    left, right = _sides(t)
    return left.join(right, "k", "full")


@query("join_index", "J5", "SELECT k, lv, rv, FALSE AS is_outer FROM " + _SIDES.format(how="LEFT")
       + " UNION ALL SELECT k, lv, rv, TRUE FROM " + _SIDES.format(how="FULL"))
def join_index(t):
    left, right = _sides(t)
    return joins.index_join(left, right, "k", "left").withColumn("is_outer", F.lit(False)).unionByName(
        joins.index_join(left, right, "k", "outer").withColumn("is_outer", F.lit(True)))


@query("align_add", "J6", """
SELECT COALESCE(a.k, b.k) AS k, a.v + b.v AS v FROM
 (SELECT l_partkey AS k, SUM(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a FULL JOIN
 (SELECT l_partkey AS k, SUM(l_quantity) AS v FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) b ON a.k = b.k""")
def align_add(t):
    def side(flag):
        return t.lineitem.where(c("l_returnflag") == flag).groupBy(c("l_partkey").alias("k")).agg(
            F.sum("l_quantity").alias("v"))
    return joins.align_add(side("A"), side("N"), "k", "v")


@query("concat_columns", "J7", """
SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day,
 MAX(o_totalprice) FILTER (o_orderstatus = 'F') AS "F_high", MIN(o_totalprice) FILTER (o_orderstatus = 'F') AS "F_low",
 MAX(o_totalprice) FILTER (o_orderstatus = 'O') AS "O_high", MIN(o_totalprice) FILTER (o_orderstatus = 'O') AS "O_low"
FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1""")
def concat_columns(t):
    def panel(status):
        return (t.orders.where(c("o_orderstatus") == status)
                .groupBy(F.to_date("o_orderdate").cast("string").alias("day"))
                .agg(F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low")))
    return joins.concat_columns({"F": panel("F"), "O": panel("O")}, "day")


@query("join_theta", "J8", """
SELECT c_custkey, n_name FROM customer JOIN nation ON c_acctbal > 9000 AND n_nationkey > 20""")
def join_theta(t):
    bright = t.customer.where(c("c_acctbal") > 9000)
    hot = t.nation.where(c("n_nationkey") > 20)
    return joins.theta_join(bright, hot, None, "c_custkey", "n_nationkey").select("c_custkey", "n_name")


@query("join_ratio", "J9", """
SELECT o_orderkey, o_totalprice / c_acctbal AS ratio FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_acctbal > 1000 ORDER BY ratio""")
def join_ratio(t):
    stars = t.customer.where(c("c_acctbal") > 1000).select(c("c_custkey").alias("k"), "c_acctbal")
    planets = t.orders.select(c("o_custkey").alias("k"), "o_orderkey", "o_totalprice")
    return joins.ratio_join(stars, planets, "k", "o_totalprice", "c_acctbal").select("o_orderkey", "ratio").orderBy("ratio")


@query("join_lookup", "J14", """
SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey""")
def join_lookup(t):
    return t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")).select("l_orderkey", "l_linenumber", "p_name")


# --- set operations --------------------------------------------------------

@query("union_all", "U1, U2", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(t):
    return t.customer.select(c("c_nationkey").alias("k")).unionByName(t.supplier.select(c("s_nationkey").alias("k")))


@query("distinct_rows", "U3", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_rows(t):
    return t.lineitem.select("l_partkey", "l_suppkey").distinct()


@query("unique_in_order", "U3", "SELECT o_custkey, MIN(o_orderkey) AS first_pos FROM orders GROUP BY o_custkey ORDER BY 2")
def unique_in_order(t):
    return setops.unique_in_order(t.orders, "o_custkey", "o_orderkey").orderBy("first_pos")


_A = "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 25"
_B = "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25"


def _ab(t):
    def side(flag):
        return t.lineitem.where((c("l_returnflag") == flag) & (c("l_quantity") > 25)).select(c("l_partkey").alias("k"))
    return side("A"), side("R")


@query("set_union", "U4", f"{_A} UNION {_B}")
def set_union(t):
    a, b = _ab(t)
    return a.union(b).distinct()


@query("set_intersect", "U5", f"{_A} INTERSECT {_B}")
def set_intersect(t):
    a, b = _ab(t)
    return a.intersect(b)


@query("set_except", "U6", f"{_A} EXCEPT {_B}")
def set_except(t):
    a, b = _ab(t)
    return a.subtract(b)


@query("set_symdiff", "U7", f"({_A} EXCEPT {_B}) UNION ALL ({_B} EXCEPT {_A})")
def set_symdiff(t):
    return setops.symmetric_difference(*_ab(t))


@query("set_relations", "U8", f"""
SELECT NOT EXISTS ({_A} EXCEPT {_B}) AS is_subset, NOT EXISTS ({_B} EXCEPT {_A}) AS is_superset,
 NOT EXISTS ({_A} INTERSECT {_B}) AS is_disjoint""")
def set_relations(t):
    return setops.set_relations(*_ab(t))
