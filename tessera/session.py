"""Checkpoints; row numbers and running sums without a single-partition window."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_fresh = itertools.count()


def fresh(kind: str) -> str:
    """A hidden column name that no other frame has."""
    return f"__{kind}{next(_fresh)}"


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the session names.

    Where none is named one is made, but only if there is no other machine
    (a local master); on a cluster that raises.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again."""
    path = f"{shared_folder(df.sparkSession)}/{kind}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, order: list[Column]) -> tuple[DataFrame, Column, Column, str]:
    """``df`` sorted over its partitions and checkpointed; the number of a
    row's partition, the row's place in it, and the hidden column of both."""
    seed = fresh("seed")
    out = cut((df.orderBy(*order) if order else df).withColumn(seed, F.monotonically_increasing_id()))
    return out, F.shiftright(F.col(seed), 33), F.col(seed).bitwiseAND((1 << 33) - 1), seed


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with row numbers from 0 in ``order``.

    Rows are range-partitioned and sorted, then checkpointed; a number is a
    row's place in its partition plus the rows of the partitions before, of
    which only one count for each partition reaches the driver.
    """
    out, part, place, seed = placed(df, order)
    counts = sorted((r[0], r[1]) for r in out.groupBy(part.alias("p")).count().collect())
    before = list(itertools.accumulate((n for _, n in counts), initial=0))
    # one row for each partition
    offsets = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)] or [(0, 0)], "__part long, __before long")
    return out.join(F.broadcast(offsets), part == F.col("__part")).withColumn(name, F.col("__before") + place).drop("__part", "__before", seed)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``df`` with running sums in ``order``: those within each partition plus
    the sums of the partitions before, one row for each of which reaches the
    driver.  No task gets all rows."""
    out, part, place, seed = placed(df, order)
    number = fresh("part")
    out = out.withColumn(number, part)
    totals = out.groupBy(number).agg(*(F.sum(c).alias(n) for n, c in sums.items())).orderBy(number)
    schema, before, rows = totals.schema, [None] * len(sums), []
    for row in totals.collect():
        rows.append((row[0], *before))
        before = [a if b is None else b if a is None else a + b for a, b in zip(before, row[1:], strict=True)]
    name = fresh("of")
    offsets = df.sparkSession.createDataFrame(rows, schema).withColumnsRenamed({number: name, **{n: f"{n}{name}" for n in sums}})
    w = Window.partitionBy(number).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    for n, c in sums.items():
        out = out.withColumn(n, F.sum(c).over(w))
    out = out.join(F.broadcast(offsets), F.col(number) == F.col(name))
    for n in sums:
        there, here = F.col(f"{n}{name}"), F.col(n)
        out = out.withColumn(n, F.when(there.isNull(), here).when(here.isNull(), there).otherwise(there + here))
    return out.drop(number, name, seed, *(f"{n}{name}" for n in sums))
