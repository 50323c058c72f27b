"""Lines of block-compressed (BGZF) files, read in parallel.

Such a file is a row of gzip members of at most 64 KB, each with its size in
its header.  The four bytes before that size are ASCII, so Spark can split
files at them as if they ended lines; a task then unpacks the blocks that
begin in its part.  Where those bytes stand inside a block by chance, the size
tells, and the parts are put together again (in the rare case that the part of
a file ends there, an error is raised).  A line that runs over the end of a
part is put together from its pieces.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: the subfield that holds a block's size, the bytes
# of the header before it, and of header and size together.
MARK = b"BC\x02\x00"
BEFORE = 12
HEADER = 18

_LINES = "f string, at long, n long, kind string, value string"
_LAST = 1 << 62


def _blocks(rows: Iterator[bytes], at: int) -> Iterator[bytes]:
    """The unpacked blocks of one part of a file."""
    held = None
    for i, row in enumerate(rows):
        if i == 0 and at == 0:
            if len(row) > BEFORE:
                yield gzip.decompress(row)  # members without a size
            continue
        held = row if held is None else held + MARK + row
        size = int.from_bytes(held[:2], "little") + 1 - HEADER
        if len(held) >= 2 + size:
            yield zlib.decompress(held[2 : 2 + size - 8], -zlib.MAX_WBITS)
            held = None
    if held is not None:
        raise ValueError("a compressed block is cut off")


def _lines(blocks: Iterator[bytes], f: str, at: int) -> Iterator[pd.DataFrame]:
    """Whole lines, and (in hexadecimal, as they may end inside a character)
    what stands before the first and after the last end of a line: the rest of
    a line that began earlier, and the start of one."""
    carry, n, met = b"", 0, at == 0
    for block in blocks:
        *whole, carry = (carry + block).split(b"\n")
        if whole:
            kinds = ["line" if met else "head"] + ["line"] * (len(whole) - 1)
            values = [x.decode() if kind == "line" else x.hex() for kind, x in zip(kinds, whole, strict=True)]
            yield pd.DataFrame({"f": f, "at": at, "n": range(n, n + len(whole)), "kind": kinds, "value": values})
            n, met = n + len(whole), True
    if carry or not met:
        yield pd.DataFrame({"f": [f], "at": [at], "n": [_LAST], "kind": ["tail" if met else "inner"], "value": [carry.hex()]})


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def rows() -> Iterator[tuple[str, int, bytes]]:
        for pdf in batches:
            yield from zip(pdf["f"], pdf["at"], pdf["raw"], strict=True)

    stream = rows()
    row = next(stream, None)
    while row is not None:
        f, at, _ = row

        def part() -> Iterator[bytes]:
            nonlocal row
            while row is not None and row[:2] == (f, at):  # noqa: B023
                yield row[2]
                row = next(stream, None)

        yield from _lines(_blocks(part(), at), f, at)


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    """The lines of one file that run over ends of parts."""
    out, start, held = [], None, b""
    for r in pdf.sort_values(["at", "n"]).itertuples():
        if r.kind == "head":
            out.append((r.f, r.at if start is None else start, -1 if start is None else _LAST, "line", (held + bytes.fromhex(r.value)).decode()))
            start, held = None, b""
        else:
            start, held = r.at if start is None else start, held + bytes.fromhex(r.value)
    if held:
        out.append((pdf["f"].iloc[0], start, _LAST, "line", held.decode()))
    return pd.DataFrame(out, columns=["f", "at", "n", "kind", "value"])


def read_blocked(spark: SparkSession, path: str) -> DataFrame:
    """value, f, at, n: lines with their file, part and place in it."""
    raw = spark.read.text(path, lineSep=MARK.decode()).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("raw"))
    every = raw.mapInPandas(_unpack, _LINES)
    # two rows at most for each part of a file
    pieces = every.where("kind <> 'line'").groupBy("f").applyInPandas(_joined, _LINES)
    return every.where("kind = 'line'").unionByName(pieces).select("value", "f", "at", "n")
