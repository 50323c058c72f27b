"""Aggregates of the values of a group that aren't NA.

A group without such values gives ``na``.  Each is a function of the frame,
as the order of rows matters for first, last and Python aggregates.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Aggregate:
    """build(c, order, kind) for column c, a sortable row position and c's type."""

    def __init__(self, column: str, build: Callable[[Column, Column, str], Column], na: Any = None, ordered: bool = False):
        self.column, self.build, self.na, self.ordered = column, build, na, ordered

    def to_column(self, types: dict[str, str], order: Column | None, where: Column | None = None) -> Column:
        c = F.col(f"`{self.column}`")
        c = c if where is None else F.when(where, c)
        kind = types[self.column]
        out = F.when(F.count(c) > 0, self.build(c, order, kind))
        return out if self.na is None else F.coalesce(out, F.lit(self.na))


def _finite(c: Column, kind: str) -> Column:
    return F.when(~F.isnan(c), c) if kind in ("double", "float") else c


class Agg:
    @staticmethod
    def has_data(c: str, na: Any = None) -> Aggregate:
        return Aggregate(c, lambda x, o, k: F.lit(True), na)

    @staticmethod
    def count(c: str, na: Any = None) -> Aggregate:
        return Aggregate(c, lambda x, o, k: F.count(x), na)

    @staticmethod
    def true_count(c: str, na: Any = None) -> Aggregate:
        return Aggregate(c, lambda x, o, k: F.count_if(x), na)

    @staticmethod
    def sum(c: str, na: Any = None) -> Aggregate:
        """In the column's own type; an overflow raises."""
        return Aggregate(c, lambda x, o, k: F.sum(x).cast(k), na)

    @staticmethod
    def sum_into(c: str, to: str, na: Any = None) -> Aggregate:
        return Aggregate(c, lambda x, o, k: F.sum(x.cast(to)).cast(to), na)

    @staticmethod
    def mean(c: str, na: Any = None) -> Aggregate:
        return Aggregate(c, lambda x, o, k: F.avg(x.cast("double")), na)

    @staticmethod
    def true_freq(c: str, na: Any = None) -> Aggregate:
        return Aggregate(c, lambda x, o, k: F.avg(x.cast("int").cast("double")), na)

    @staticmethod
    def first(c: str, na: Any = None) -> Aggregate:
        return Aggregate(c, lambda x, o, k: F.min_by(x, F.when(x.isNotNull(), o)), na, ordered=True)

    @staticmethod
    def last(c: str, na: Any = None) -> Aggregate:
        return Aggregate(c, lambda x, o, k: F.max_by(x, F.when(x.isNotNull(), o)), na, ordered=True)

    @staticmethod
    def min(c: str, na: Any = None) -> Aggregate:
        return Aggregate(c, lambda x, o, k: F.min(x), na)

    @staticmethod
    def max(c: str, na: Any = None) -> Aggregate:
        return Aggregate(c, lambda x, o, k: F.max(x), na)

    @staticmethod
    def min_f64(c: str, na: Any = None) -> Aggregate:
        """NaN is passed over; infinity if there is nothing else."""
        return Aggregate(c, lambda x, o, k: F.coalesce(F.min(_finite(x, k)), F.lit(float("inf"))), na)

    @staticmethod
    def max_f64(c: str, na: Any = None) -> Aggregate:
        return Aggregate(c, lambda x, o, k: F.coalesce(F.max(_finite(x, k)), F.lit(float("-inf"))), na)

    @staticmethod
    def expr(fn: Callable[[Column], Column], c: str, na: Any = None) -> Aggregate:
        """Any Column aggregate of the values that aren't NA."""
        return Aggregate(c, lambda x, o, k: fn(x), na)

    @staticmethod
    def python(fn: Callable[[list], Any], c: str, to: str, na: Any = None) -> Aggregate:
        """Any Python function of the list of values, in row order.

        A group's list must fit in memory.  Lists go to Python in Arrow
        batches; prefer ``expr`` where Spark has the aggregate.
        """

        def build(x: Column, o: Column, k: str) -> Column:
            rows = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(o.alias("o"), x.alias("v")))))

            @F.pandas_udf(to)
            def run(lists: pd.Series) -> pd.Series:
                return pd.Series([None if v is None else fn(list(v.tolist())) for v in lists], dtype=object)

            return run(F.transform(rows, lambda r: r["v"]))

        return Aggregate(c, build, na, ordered=True)
