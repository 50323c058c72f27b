"""Delimited text: cells by position, NA for missing ones, no quoting."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import Frame
from ..session import fresh
from .blocked import read_blocked


def _cell(text: Column, kind: T.DataType, labels: Sequence[str] | None) -> Column:
    """NA, or the cell in its type; a bad cell raises."""
    text = F.trim(text)
    na = text == "NA"
    if isinstance(kind, T.BooleanType):
        upper = F.upper(text)
        return F.when(upper == "NA", None).when(upper.isin("T", "TRUE"), True).when(upper.isin("F", "FALSE"), False).otherwise(F.raise_error(F.concat(F.lit("no boolean: "), text)).cast("boolean"))
    if isinstance(kind, T.StringType):
        if labels is not None:
            return F.when(na, None).when(text.isin(*labels), text).otherwise(F.raise_error(F.concat(F.lit("no label: "), text)).cast("string"))
        return F.when(na, None).otherwise(text)
    return F.when(~na, text.cast(kind))


def _parse(lines: DataFrame, order: list[str], schema: str | T.StructType, sep: str, labels: dict[str, Sequence[str]] | None, auto_label: bool) -> Frame:
    schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    labels = labels or {}
    parts = F.split(F.regexp_replace("value", "\r$", ""), "\\Q" + sep + "\\E", -1)
    checked = F.when(F.size("__cells") >= len(schema), F.col("__cells")).otherwise(F.raise_error(F.lit("a line has too few cells")).cast("array<string>"))
    cells = lines.withColumn("__cells", parts).withColumn("__cells", checked)
    df = cells.select(*(_cell(F.col("__cells")[i], f.dataType, None if auto_label else labels.get(f.name)).alias(f.name) for i, f in enumerate(schema)), *order)
    frame = Frame(df, tuple(schema.names), tuple((o, False) for o in order))
    for name, values in labels.items():
        if auto_label:
            found = frame.factorize(name).labels(name)
            values = [*values, *(x for x in found if x not in values)]
        frame = frame.set_labels(name, values)
    return frame


def read_text(spark: SparkSession, path: str, schema: str | T.StructType, sep: str = "\t", header: bool = False, labels: dict[str, Sequence[str]] | None = None, auto_label: bool = False) -> Frame:
    """Files (.gz and .bgz too) by a schema; cells beyond it are passed over.

    Lines are in the order of files, of blocks in a file, and in a block.
    """
    if path.endswith(".bgz"):
        lines = read_blocked(spark, path)  # Spark doesn't know the name
    else:
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("at")).withColumn("n", F.monotonically_increasing_id())
    if header:
        first = lines.where("at = 0").groupBy("f").agg(F.min("n").alias("first")).withColumnRenamed("f", "of")  # one row for each file
        lines = lines.join(first, F.col("f") == F.col("of")).where(F.col("n") != F.col("first"))
    names = [fresh("ord") for _ in range(3)]
    return _parse(lines.select("value", *(F.col(c).alias(n) for c, n in zip(("f", "at", "n"), names, strict=True))), names, schema, sep, labels, auto_label)


def read_bytes(spark: SparkSession, data: bytes, schema: str | T.StructType, sep: str = "\t", header: bool = False, labels: dict[str, Sequence[str]] | None = None, auto_label: bool = False) -> Frame:
    lines = data.decode().split("\n")
    lines = lines[:-1] if lines and lines[-1] == "" else lines
    seed = fresh("ord")
    df = spark.createDataFrame([(x, i) for i, x in enumerate(lines[1:] if header else lines)], f"value string, `{seed}` long")
    return _parse(df, [seed], schema, sep, labels, auto_label)


def read_stdin(spark: SparkSession, schema: str | T.StructType, **options) -> Frame:
    """Standard input, read to its end on the driver."""
    return read_bytes(spark, sys.stdin.buffer.read(), schema, **options)


def _as_text(frame: Frame) -> DataFrame:
    cells = []
    for c, kind in frame.types.items():
        x = F.col(f"`{c}`")
        cells.append(F.coalesce(x.cast("string"), F.lit("NA")).alias(c))
    return frame.df.orderBy(*frame.ordering()).select(*cells) if frame.order else frame.df.select(*cells)


def write_text(frame: Frame, path: str | None = None, sep: str = "\t", header: bool = False) -> None:
    """A folder of files in order, gzipped if its name ends in .gz; without a
    path to standard output.  NA is written NA, a factor by its label."""
    rows = _as_text(frame)
    line = F.concat_ws(sep, *(F.col(f"`{c}`") for c in frame.columns)).alias("value")
    head = sep.join(frame.columns)
    if path is None:
        out = ([head] if header else []) + [r[0] for r in rows.select(line).toLocalIterator()]
        sys.stdout.write("".join(f"{x}\n" for x in out))
        return
    writer = rows.write.mode("overwrite").options(sep=sep, header=header, quote="", escapeQuotes="false", emptyValue="", nullValue="NA", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
    (writer.option("compression", "gzip") if path.endswith(".gz") else writer).csv(path)
