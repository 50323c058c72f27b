"""Parquet, with rows in file order."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..frame import Frame, _stored
from ..session import fresh


def read_parquet(spark: SparkSession, path: str) -> Frame:
    """The order is that of files and of rows in them; it comes from the
    scan's metadata, so filters and column selection still reach the scan."""
    df = spark.read.parquet(path)
    a, b = fresh("ord"), fresh("ord")
    out = df.select("*", F.col("_metadata.file_path").alias(a), F.col("_metadata.row_index").alias(b))
    return Frame(out, tuple(df.columns), ((a, False), (b, False)), _stored(df))
