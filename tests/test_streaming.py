from pyspark.sql import functions as F

from lumentab.functions import strings as S
from lumentab.operators import relational as rel
from lumentab.operators import text as tx
from lumentab.operators import web


def test_row_wise_operators_accept_a_stream(spark, tmp_path):
    rows = [(1, "<title>The page</title><p class='a'>x</p>"), (2, "<title>Other</title>")]
    spark.createDataFrame(rows, "id int, html string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, html string").parquet(str(tmp_path / "in"))
    out = rel.mask_elementwise(stream, ["id"], lambda c: c > 1).select(
        "id", S.capitalize(web.title(F.col("html"))).alias("title"), tx.tokens(F.col("html")).alias("tokens"))
    query = out.writeStream.format("memory").queryName("pages_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r.id, r.title) for r in spark.table("pages_out").collect()}
    assert got == {(None, "The page"), (2, "Other")}
