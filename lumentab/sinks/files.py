"""Writers.  Each task writes its own files; nothing is gathered first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, header: bool = True, append: bool = False) -> None:
    """CSV; quotes inside fields are doubled, an empty string stays apart from NULL."""
    (df.write.mode("append" if append else "overwrite").option("header", header).option("escape", '"')
     .option("emptyValue", '""').csv(path))


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_table(df: DataFrame, name: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").saveAsTable(name)


def write_database(df: DataFrame, url: str, table: str, append: bool = True) -> None:
    df.write.mode("append" if append else "overwrite").format("jdbc").option("url", url).option("dbtable", table).save()


def write_match_report(matches: DataFrame, path: str) -> None:
    """Tab-separated id1, id2, distance in degrees, with a header line, in id order."""
    report = matches.select(F.col("id1"), F.col("id2"), F.col("dist").alias("distance_deg")).orderBy("id1")
    report.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)


def write_ascii(df: DataFrame, path: str) -> None:
    """Blank-separated table with a header line."""
    df.write.mode("overwrite").option("header", True).option("sep", " ").csv(path)
