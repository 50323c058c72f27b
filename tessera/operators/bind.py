"""Binding frames by rows and by columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..frame import Frame
from ..session import fresh


def rbind(*frames: Frame) -> Frame:
    """Rows of one frame after another; names, order and types must agree."""
    first = frames[0]
    for f in frames[1:]:
        if f.columns != first.columns or f.types != first.types:
            raise ValueError("frames must have the same columns and types")
        if f.levels != first.levels and set(f.levels) != set(first.levels):
            raise ValueError("frames must have the same factors")
    kinds = [[(f.df.schema[h].dataType, d) for h, d in f.order] for f in frames]
    branch = fresh("ord")
    if all(k == kinds[0] for k in kinds):
        new = [fresh("ord") for _ in first.order]
        parts = [f.df.select(*(F.col(f"`{c}`") for c in f.columns), F.lit(i).alias(branch), *(F.col(h).alias(n) for (h, _), n in zip(f.order, new, strict=True))) for i, f in enumerate(frames)]
        order = ((branch, False), *((n, d) for n, (_, d) in zip(new, first.order, strict=True)))
    else:
        place = fresh("ord")
        parts = [f.numbered(place).select(*(F.col(f"`{c}`") for c in f.columns), F.lit(i).alias(branch), place) for i, f in enumerate(frames)]
        order = ((branch, False), (place, False))
    labels = {c: tuple(dict.fromkeys(x for f in frames for x in f.levels[c])) for c in first.levels}
    return Frame(reduce(lambda a, b: a.union(b), parts), first.columns, order, labels)


def cbind(*frames: Frame) -> Frame:
    """Columns side by side, row by row; a frame of one row is recycled and
    one of none gives NA."""
    return reduce(_beside, frames)


def _beside(left: Frame, right: Frame) -> Frame:
    if clash := set(left.columns) & set(right.columns):
        raise ValueError(f"both have a column {sorted(clash)[0]}")
    n, m = left.count(), right.count()
    columns, levels = (*left.columns, *right.columns), {**left.levels, **right.levels}
    if n != m and min(n, m) > 1:
        raise ValueError(f"{n} and {m} rows")
    if n == m and n > 0 or not left.columns or not right.columns:
        if not left.columns or not right.columns:
            return right if not left.columns else left
        a, b = fresh("row"), fresh("row")
        df = left.numbered(a).join(right.numbered(b).select(*(F.col(f"`{c}`") for c in right.columns), b), F.col(a) == F.col(b)).drop(a, b)
        return Frame(df, columns, left.order, levels)
    long, short, one = (left, right, m) if n >= m else (right, left, n)
    if one:
        row = short.df.select(*(F.col(f"`{c}`") for c in short.columns))  # one row
        df = long.df.crossJoin(F.broadcast(row))
    else:
        df = long.df.select("*", *(F.lit(None).cast(short.df.schema[c].dataType).alias(c) for c in short.columns))
    return Frame(df.select(*(F.col(f"`{c}`") for c in columns), *(h for h, _ in long.order)), columns, long.order, levels)
