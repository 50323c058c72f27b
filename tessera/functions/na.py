"""Predicates in which NA (null) is a value, less than all others.

``lt("a", 20)`` compares a column with a value, ``ge("a", "b")`` two columns;
``value("x")`` marks a string as a value.  NaN is never less, greater or
equal.  Predicates combine with ``&``, ``|`` and ``~``.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Predicate:
    """Builds a Column, never null, from the types of a frame's columns."""

    def __init__(self, build: Callable[[dict[str, str]], Column]):
        self.build = build

    def __and__(self, other: Predicate) -> Predicate:
        return Predicate(lambda t: self.build(t) & as_predicate(other).build(t))

    def __or__(self, other: Predicate) -> Predicate:
        return Predicate(lambda t: self.build(t) | as_predicate(other).build(t))

    def __invert__(self) -> Predicate:
        return Predicate(lambda t: ~self.build(t))


class value:  # noqa: N801
    def __init__(self, it: Any):
        self.it = it


def as_predicate(x: Predicate | Column) -> Predicate:
    return x if isinstance(x, Predicate) else Predicate(lambda _: F.coalesce(x, F.lit(False)))


class _Side:
    """One operand: its column, whether it can be null, whether NaN."""

    def __init__(self, x: Any, types: dict[str, str]):
        if isinstance(x, str):
            self.col, self.null, self.nan = F.col(f"`{x}`"), F.col(f"`{x}`").isNull(), F.isnan(F.col(f"`{x}`")) if types[x] in ("double", "float") else None
        elif isinstance(x, Column):
            self.col, self.null, self.nan = x, x.isNull(), None
        else:
            x = x.it if isinstance(x, value) else x
            self.col, self.null = F.lit(x), F.lit(True) if x is None else None
            self.nan = F.lit(True) if x != x else None


def _both(*conditions: Column | None) -> Column:
    kept = [c for c in conditions if c is not None]
    out = kept[0]
    for c in kept[1:]:
        out = out & c
    return out


def _not(c: Column | None) -> Column | None:
    return None if c is None else ~c


def _plain(a: _Side, b: _Side, compared: Column) -> Column:
    """The comparison, false if a side is null or NaN."""
    return F.coalesce(_both(compared, _not(a.nan), _not(b.nan)), F.lit(False))


def _less(x: Any, y: Any) -> Predicate:
    def build(types: dict[str, str]) -> Column:
        a, b = _Side(x, types), _Side(y, types)
        if a.null is None:
            return _plain(a, b, a.col < b.col)
        if b.null is None and b.nan is None:
            return a.null | (a.col < b.col)  # NaN is never less
        return _both(a.null, _not(b.null)) | _plain(a, b, a.col < b.col)

    return Predicate(build)


def _least(x: Any, y: Any) -> Predicate:
    def build(types: dict[str, str]) -> Column:
        a, b = _Side(x, types), _Side(y, types)
        if a.null is None:
            return _plain(a, b, a.col <= b.col)
        if b.null is None and b.nan is None:
            return a.null | (a.col <= b.col)
        return a.null | _plain(a, b, a.col <= b.col)

    return Predicate(build)


def lt(a: Any, b: Any) -> Predicate:
    return _less(a, b)


def gt(a: Any, b: Any) -> Predicate:
    return _less(b, a)


def le(a: Any, b: Any) -> Predicate:
    return _least(a, b)


def ge(a: Any, b: Any) -> Predicate:
    return _least(b, a)


def eq(a: Any, b: Any) -> Predicate:
    def build(types: dict[str, str]) -> Column:
        x, y = _Side(a, types), _Side(b, types)
        return _both(x.col.eqNullSafe(y.col), F.coalesce(_not(x.nan), F.lit(True)) if x.nan is not None else None)

    return Predicate(build)


def ne(a: Any, b: Any) -> Predicate:
    return ~eq(a, b)


def is_none(a: str) -> Predicate:
    return Predicate(lambda _: F.col(f"`{a}`").isNull())


def is_some(a: str) -> Predicate:
    return Predicate(lambda _: F.col(f"`{a}`").isNotNull())


def expr(fn: Callable[..., Column], *columns: str) -> Predicate:
    """A Column function of any number of columns; null counts as false."""
    return as_predicate(fn(*(F.col(f"`{c}`") for c in columns)))


def closure(fn: Callable[..., bool], *columns: str) -> Predicate:
    """Any Python function of cells (None is NA): Arrow batches, no pushdown."""

    @F.pandas_udf("boolean")
    def run(*series: pd.Series) -> pd.Series:
        rows = zip(*(s.astype(object).where(s.notna(), None) for s in series), strict=True)
        return pd.Series([bool(fn(*r)) for r in rows], dtype=bool)

    return as_predicate(run(*(F.col(f"`{c}`") for c in columns)))
