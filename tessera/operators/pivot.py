"""Long to wide, by conditional aggregation over known categories."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..frame import Frame, desc
from .group import Grouped, ranked

#: Categories become columns, so there can't be more.
MAX_CATEGORIES = 10_000


def categories(frame: Frame, on: str, keys: Sequence[str]) -> list[Any]:
    """Values of ``on`` as first met, going through groups in their order."""
    df, rank = ranked(frame, ())
    by = [F.col(f"`{k}`") for k in keys]
    seen = df.groupBy(*by, F.col(f"`{on}`").alias("__on")).agg(F.min(rank).alias("__first"))
    if keys:
        seen = seen.withColumn("__group", F.min("__first").over(Window.partitionBy(*by)))
        met = seen.groupBy("__on").agg(F.min(F.struct("__group", "__first")).alias("__first"))
    else:
        met = seen
    rows = met.orderBy("__first").select("__on").limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"{on} has more than {MAX_CATEGORIES} values")
    return [r[0] for r in rows]


def pivot(frame: Frame, keys: Sequence[str | desc], on: str, fill: Any, kind: str, labels: Sequence[str] | None, sort: bool | Sequence[str | desc]) -> Frame:
    """A row for each group of keys, a column for each value of ``on``.

    ``kind`` count or bool without ``fill``; else ``fill`` is an Agg.  A
    factor gives all its labels, a boolean false and true, others what they
    hold (NA is named NA) unless ``labels`` are given.
    """
    frame._need(on)
    grouped = Grouped(frame, keys, sort)
    if frame.types[on] in ("double", "float"):
        raise ValueError("can't pivot on a floating-point column")
    if labels is not None:
        values: list[Any] = list(labels)
    elif on in frame.levels:
        values = frame.labels(on)
    elif frame.types[on] == "boolean":
        values = [False, True]
    else:
        values = categories(grouped.frame, on, grouped.keys)
    names = ["NA" if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in values]
    if clash := [n for n in names if n in grouped.keys]:
        raise ValueError(f"category {clash[0]} has the name of a key")
    if len(set(names)) < len(names):
        raise ValueError("two categories of one name")
    statements = {n: _Cell(F.col(f"`{on}`").eqNullSafe(F.lit(v)), fill, kind, on) for n, v in zip(names, values, strict=True)}
    return grouped.aggregate(**statements)


class _Cell:
    """An aggregate over the rows of one category."""

    def __init__(self, where, fill, kind: str, on: str):
        if fill is None and kind not in ("count", "bool"):
            raise ValueError(kind)
        self.where, self.fill, self.kind = where, fill, kind
        self.column = on if fill is None else fill.column
        self.ordered = fill is not None and fill.ordered

    def to_column(self, types: dict[str, str], order):
        if self.fill is not None:
            return self.fill.to_column(types, order, self.where)
        return F.count_if(self.where) if self.kind == "count" else F.count_if(self.where) > 0
