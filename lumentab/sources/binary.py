"""Members of zip archives and records of .npy files, from (path, content) rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of each file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")


def zip_members(files: DataFrame) -> DataFrame:
    """(path, member, data): one row per file inside each archive."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for info in archive.infolist():
                        if not info.is_dir():
                            yield pd.DataFrame({"path": [path], "member": [info.filename], "data": [archive.read(info)]})

    return files.select(F.col("path").cast("string").alias("path"), "content").mapInPandas(
        unpack, "path string, member string, data binary")


def npy_records(files: DataFrame, schema: str) -> DataFrame:
    """Rows of structured .npy arrays; byte-string fields are decoded."""

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                records = np.load(io.BytesIO(content), allow_pickle=False)
                columns = {}
                for name in records.dtype.names:
                    values = records[name]
                    columns[name] = np.char.decode(values, "utf-8") if values.dtype.kind == "S" else values
                yield pd.DataFrame(columns)

    return files.select("content").mapInPandas(load, schema)
