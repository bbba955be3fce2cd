"""File readers.  Schemas are given, not inferred, wherever the layout is known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True, multiline: bool = False,
             sep: str = ",") -> DataFrame:
    """Delimited file.  ``multiline`` lets quoted fields hold line breaks, at the
    price of reading each file in one task; leave it off where no field does."""
    reader = spark.read.option("header", header).option("sep", sep).option("multiLine", multiline)
    reader = reader.option("quote", '"').option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_columns(spark: SparkSession, path: str, schema: str, columns: Sequence[str], sep: str = ",") -> DataFrame:
    """Headerless numeric file, only some columns; the selection reaches the scan."""
    return (spark.read.option("sep", sep).option("ignoreLeadingWhiteSpace", True).schema(schema).csv(path)
            .select(*columns))


def read_catalogue(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Catalogue with blank-separated fields of uneven length.

    The first token is the identifier (a trailing ``*`` is dropped); the next
    tokens become ``columns`` as text, NULL where a line is short.
    """
    tokens = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("t")).where(F.get("t", F.lit(0)) != "")
    ident = F.regexp_replace(F.get("t", F.lit(0)), r"\*$", "").try_cast("bigint").alias("id")
    return tokens.select(ident, *[F.get("t", F.lit(i + 1)).alias(n) for i, n in enumerate(columns)])


def read_with_row_label(spark: SparkSession, path: str, schema: str, label: str = "row_label") -> DataFrame:
    """CSV whose first header cell is empty: the first column is the row label."""
    frame = read_csv(spark, path, schema)
    return frame.withColumnRenamed(frame.columns[0], label)


def read_tree(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """All text files below a folder: (path, value) per line, or per file if ``whole``.

    Lines are the default, as a whole file is a single row of a single task.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    frame = reader.text(path, wholetext=True) if whole else reader.option("lineSep", "\n").text(path)
    return frame.select(F.col("_metadata.file_path").alias("path"), "value")


def read_database(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int = 64) -> DataFrame:
    """Database table, read by parallel ranges of a numeric key."""
    return (spark.read.format("jdbc").option("url", url).option("dbtable", table).option("partitionColumn", key)
            .option("lowerBound", low).option("upperBound", high).option("numPartitions", partitions).load())


def copy_from(spark: SparkSession, path: str, schema: str, table: str) -> None:
    """Bulk load of a headerless CSV into an existing table, columns by position."""
    spark.read.schema(schema).csv(path).write.insertInto(table)


def read_votable(spark: SparkSession, data_path: str, fields_path: str | None = None) -> DataFrame:
    """VOTable (XML, TABLEDATA form): names, types and units from the FIELD elements.

    The file is split at the ends of its TR elements, so a large one is read by
    many tasks and no task holds a whole document.  Only the FIELD elements, one
    per column and all at the head of the file, are looked at on the driver.
    The unit of a column is kept in its metadata and empty cells are NULL.
    """
    tags = spark.read.option("lineSep", "<").text(fields_path or data_path).where(F.col("value").startswith("FIELD"))

    def attribute(name: str):
        return F.regexp_extract("value", rf'\s{name}\s*=\s*"([^"]*)"', 1).alias(name)

    fields = tags.select(attribute("name"), attribute("datatype"), attribute("unit")).collect()
    types = {"double": "double", "float": "float", "int": "int", "long": "bigint", "short": "smallint",
             "boolean": "boolean", "char": "string", "unicodeChar": "string"}
    inner = F.regexp_extract("value", r"(?s)<TR(?:\s[^>]*)?>(.*)$", 1)
    rows = (spark.read.option("lineSep", "</TR>").text(data_path).select(inner.alias("x")).where(F.col("x") != "")
            .select(F.from_xml(F.concat(F.lit("<TR>"), "x", F.lit("</TR>")), F.lit("TD array<string>")).alias("r"))
            .select("r.TD"))
    cells = []
    for i, f in enumerate(fields):
        text = F.nullif(F.trim(F.get("TD", F.lit(i))), F.lit(""))
        value = text.try_cast(types.get(f["datatype"], "string"))
        cells.append(value.alias(f["name"], metadata={"unit": f["unit"]}))
    return rows.select(*cells)
