"""Appending arriving files to a frame's query, one micro-batch at a time.

Frames are batch tables; the nearest thing to a stream is reading input to its
end in chunks.  Here each micro-batch of a file stream is one such chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..frame import Frame


def append_files(spark: SparkSession, source: str, schema: T.StructType, query: Callable[[Frame], Frame], target: str, checkpoint: str):
    """Runs ``query`` on the Parquet files that arrive in ``source`` and
    appends its rows to ``target``; returns the streaming query."""

    def each(batch: DataFrame, number: int) -> None:
        query(Frame.of(batch)).to_spark().write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
