"""Sources and sinks: the tables are written to the shared folder and read back."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lumentab.functions import sky as S
from lumentab.operators.sky import crossmatch
from lumentab.plans.registry import query
from lumentab.plans.sky import RADIUS, _CAT, _PAIRS, catalogue, shifted
from lumentab.plans.statistics import r
from lumentab.session import scratch_path
from lumentab.sinks import files as out
from lumentab.sources import binary, files

c = F.col

CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("scan_csv", "S1, K1", "SELECT doc_id, text, lang FROM documents WHERE text <> ''")
def scan_csv(t):
    path = scratch_path(t.spark, "csv")
    rows = t.documents.where(c("text") != "").select("doc_id", "text", "lang")
    out.write_csv(rows, path)
    return files.read_csv(t.spark, path, "doc_id bigint, text string, lang string", multiline=True)


@query("scan_prune", "S2", "SELECT c_custkey, c_acctbal FROM customer")
def scan_prune(t):
    path = scratch_path(t.spark, "prune")
    out.write_csv(t.customer, path, header=False)
    return files.read_columns(t.spark, path, CUSTOMER, ["c_custkey", "c_acctbal"])


@query("scan_tsv", "S3, K6", "SELECT role AS label, text AS message FROM conversations")
def scan_tsv(t):
    path = scratch_path(t.spark, "tsv")
    (t.conversations.select("role", "text").write.option("sep", "\t").option("escape", '"').csv(path))
    return files.read_csv(t.spark, path, "label string, message string", header=False, multiline=True, sep="\t")


@query("scan_whitespace", "S4, M6", """
SELECT c_custkey AS id, ROUND((h + m / 60 + s / 3600) * 15, 6) AS ra, ROUND(CASE WHEN c_custkey % 2 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * (d + m / 60 + s / 3600), 6) + 0.0 AS dec
FROM (SELECT c_custkey, c_custkey % 24 AS h, c_custkey % 60 AS m, c_custkey % 59 + 0.5 AS s, c_custkey % 90 AS d FROM customer)""")
def scan_whitespace(t):
    k = c("c_custkey")
    ident = F.concat(k.cast("string"), F.when(k % 3 == 0, "*").otherwise(""))
    sign = F.when(k % 2 == 1, "-").otherwise("+")
    parts = [ident, (k % 24).cast("string"), (k % 60).cast("string"), (k % 59 + 0.5).cast("string"),
             F.concat(sign, F.lpad((k % 90).cast("string"), 2, "0")), (k % 60).cast("string"), (k % 59 + 0.5).cast("string")]
    line = F.concat(F.lit("  "), F.concat_ws("   ", *parts), F.when(k % 4 == 0, "  1.23 n/a").otherwise(""))
    path = scratch_path(t.spark, "blanks")
    t.customer.select(line.alias("value")).write.text(path)
    cat = files.read_catalogue(t.spark, path, ["h", "m", "s", "d", "dm", "ds"])
    num = {x: c(x).cast("double") for x in ("h", "m", "s", "dm", "ds")}
    return cat.select("id", r(S.hms_to_degrees(num["h"], num["m"], num["s"])).alias("ra"),
                      r(S.dms_to_degrees(c("d"), num["dm"], num["ds"])).alias("dec"))


@query("scan_skip_header", "S5", f"WITH {_CAT} SELECT ra, ROUND(dec, 6) + 0.0 AS dec FROM cat")
def scan_skip_header(t):
    path = scratch_path(t.spark, "header")
    out.write_csv(catalogue(t).select("ra", "dec", "c_acctbal"), path)
    return files.read_csv(t.spark, path, "ra double, dec double, flux double").select("ra", r(c("dec")).alias("dec"))


@query("scan_index_col", "S6", "SELECT p_partkey AS row_label, p_size, p_retailprice FROM part")
def scan_index_col(t):
    path = scratch_path(t.spark, "index")
    out.write_csv(t.part.select(c("p_partkey").alias("_c0"), "p_size", "p_retailprice"), path)
    return files.read_with_row_label(t.spark, path, "_c0 bigint, p_size int, p_retailprice double")


@query("scan_votable", "S8", """
SELECT c_custkey AS source_id, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS parallax, c_mktsegment AS kind FROM customer""")
def scan_votable(t):
    def cell(x):
        return F.concat(F.lit("<TD>"), F.coalesce(x.cast("string"), F.lit("")), F.lit("</TD>"))
    parallax = F.when(c("c_custkey") % 5 != 0, c("c_acctbal"))
    rows = t.customer.select(F.concat(F.lit("<TR>"), cell(c("c_custkey")), cell(parallax), cell(c("c_mktsegment")), F.lit("</TR>")).alias("value"))
    field_lines = F.array(*[F.lit(x) for x in (
        '<FIELD name="source_id" datatype="long" unit=""/>', '<FIELD name="parallax" datatype="double" unit="mas"></FIELD>',
        '<FIELD name="kind" datatype="char" unit=""></FIELD>')])
    data, head = scratch_path(t.spark, "vot-data"), scratch_path(t.spark, "vot-head")
    rows.write.text(data)
    t.region.limit(1).select(F.explode(field_lines).alias("value")).coalesce(1).write.text(head)
    return files.read_votable(t.spark, data, head)


@query("sql_scan", "S9", "SELECT n_name, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def sql_scan(t):
    return t.spark.sql("SELECT n_name, count(*) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name",
                       customer=t.customer, nation=t.nation)


@query("scan_text", "S10", "SELECT UNNEST(string_split(text, chr(10))) AS value FROM conversations")
def scan_text(t):
    path = scratch_path(t.spark, "text")
    t.conversations.select("text").write.option("lineSep", "\n").text(path)
    return t.spark.read.option("lineSep", "\n").text(path)


@query("inline_rows", "S11", """
SELECT company, person, sales, (SELECT COUNT(*) FROM customer WHERE c_mktsegment = segment) AS customers FROM
 (VALUES ('north', 'Ida', 210, 'BUILDING'), ('north', 'Noor', 95, 'MACHINERY'), ('south', 'Lev', 330, 'HOUSEHOLD')) v(company, person, sales, segment)""")
def inline_rows(t):
    rows = t.spark.createDataFrame(
        [("north", "Ida", 210, "BUILDING"), ("north", "Noor", 95, "MACHINERY"), ("south", "Lev", 330, "HOUSEHOLD")],
        "company string, person string, sales int, segment string")
    per_segment = t.customer.groupBy(c("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("customers"))
    return rows.join(per_segment, "segment", "left").na.fill(0, ["customers"]).drop("segment")


@query("scan_npy", "S12", """
SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS u, CAST(embedding[2] AS DOUBLE) AS g, CASE WHEN label < 5 THEN 'GALAXY' ELSE 'QSO' END AS spec_class FROM embeddings""")
def scan_npy(t):
    def pack(batches):
        for b in batches:
            records = np.zeros(len(b), dtype=[("vec_id", "i8"), ("u", "f8"), ("g", "f8"), ("spec_class", "S6")])
            for name in ("vec_id", "u", "g"):
                records[name] = b[name]
            records["spec_class"] = np.where(b["label"] < 5, b"GALAXY", b"QSO")
            buffer = io.BytesIO()
            np.save(buffer, records)
            yield pd.DataFrame({"content": [buffer.getvalue()]})
    cols = [F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate("ug")]
    packed = t.embeddings.select("vec_id", "label", *cols).mapInPandas(pack, "content binary")
    return binary.npy_records(packed, "vec_id bigint, u double, g double, spec_class string")


@query("scan_tree", "S13", """
SELECT lang, COUNT(*) AS lines, CAST(SUM(LENGTH(line)) AS BIGINT) AS chars FROM
 (SELECT lang, UNNEST(string_split(text, chr(10))) AS line FROM documents) GROUP BY lang""")
def scan_tree(t):
    path = scratch_path(t.spark, "tree")
    t.documents.select("lang", "text").write.option("lineSep", "\n").partitionBy("lang").text(path)
    lines = files.read_tree(t.spark, path)
    lang = F.regexp_extract("path", r"lang=([a-z]+)", 1)
    return lines.groupBy(lang.alias("lang")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("value")).alias("chars"))


@query("scan_zip", "S14", "SELECT CAST(doc_id AS VARCHAR) AS path, 'doc/' || doc_id || '.txt' AS member, text FROM documents")
def scan_zip(t):
    def pack(batches):
        for b in batches:
            content = []
            for key, text in zip(b["doc_id"], b["text"]):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                    archive.writestr(f"doc/{key}.txt", text)
                content.append(buffer.getvalue())
            yield pd.DataFrame({"path": b["doc_id"].astype(str), "content": content})
    archives = t.documents.select("doc_id", "text").mapInPandas(pack, "path string, content binary")
    return binary.zip_members(archives).select("path", "member", c("data").cast("string").alias("text"))


@query("copy_from", "S16, D1", "SELECT c_custkey AS star_id, c_acctbal AS radius FROM customer")
def copy_from(t):
    path = scratch_path(t.spark, "copy")
    out.write_csv(t.customer.select("c_custkey", "c_acctbal"), path, header=False)
    place = scratch_path(t.spark, "star")
    name = "star_" + place.rsplit("-", 1)[1]
    t.spark.sql(f"CREATE TABLE {name} (star_id BIGINT, radius DOUBLE) USING parquet LOCATION '{place}'")
    files.copy_from(t.spark, path, "star_id bigint, radius double", name)
    return t.spark.table(name)


# --- sinks -----------------------------------------------------------------

@query("sink_csv", "K1", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def sink_csv(t):
    path = scratch_path(t.spark, "sink")
    out.write_csv(t.orders.select("o_orderkey", "o_totalprice", "o_orderpriority"), path)
    return files.read_csv(t.spark, path, "o_orderkey bigint, o_totalprice double, o_orderpriority string")


@query("sink_parquet", "K2", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem")
def sink_parquet(t):
    path = scratch_path(t.spark, "parquet")
    out.write_parquet(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), path)
    return t.spark.read.parquet(path)


@query("sink_append", "K3", "SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier")
def sink_append(t):
    path = scratch_path(t.spark, "append")
    out.write_csv(t.customer.select("c_custkey"), path, header=False)
    out.write_csv(t.supplier.select("s_suppkey"), path, header=False, append=True)
    return files.read_csv(t.spark, path, "k bigint", header=False)


@query("sink_table", "K4", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def sink_table(t):
    place = scratch_path(t.spark, "table")
    name = "sink_" + place.rsplit("-", 1)[1]
    # an external table keeps the files in the shared folder
    t.supplier.select("s_suppkey", "s_name", "s_acctbal").write.option("path", place).saveAsTable(name)
    return t.spark.table(name)


@query("sink_match_report", "K6", f"WITH {_PAIRS} SELECT id1, id2, ROUND(dist, 6) AS distance_deg FROM m")
def sink_match_report(t):
    path = scratch_path(t.spark, "report")
    out.write_match_report(crossmatch(catalogue(t).drop("c_acctbal"), shifted(t), RADIUS), path)
    back = files.read_csv(t.spark, path, "id1 bigint, id2 bigint, distance_deg double", sep="\t")
    return back.select("id1", "id2", r(c("distance_deg")).alias("distance_deg"))


@query("sink_ascii", "K7", f"WITH {_CAT} SELECT id, ra, ROUND(dec, 6) + 0.0 AS dec FROM cat")
def sink_ascii(t):
    path = scratch_path(t.spark, "ascii")
    out.write_ascii(catalogue(t).select("id", "ra", "dec"), path)
    return files.read_csv(t.spark, path, "id bigint, ra double, dec double", sep=" ").withColumn("dec", r(c("dec")))
