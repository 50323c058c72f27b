"""Vector functions over the rows of a group (or a whole frame), NA kept.

Some give one value for all rows (``one``), the others one for each row.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class Vector:
    """build(columns, over, running, kinds): ``over`` aggregates over all rows
    of the group and ``running`` sums those up to this one."""

    def __init__(self, columns: tuple[str, ...], build: Callable, one: bool, drops: bool = False):
        self.columns, self.build, self.one, self.drops = columns, build, one, drops

    def to_column(self, types: dict[str, str], over: Callable[[Column], Column], running: Callable[[Column], Column]) -> Column:
        return self.build([F.col(f"`{c}`") for c in self.columns], over, running, [types[c] for c in self.columns])


def _one(c: str, fn: Callable[[Column, str], Column], keep_empty: bool = False) -> Vector:
    def build(cols, over, running, kinds):
        made = over(fn(cols[0], kinds[0]))
        return made if keep_empty else F.when(over(F.count(cols[0])) > 0, made)

    return Vector((c,), build, one=True)


class Do:
    @staticmethod
    def na_rm(c: str) -> Vector:
        """The values that aren't NA, in order; other rows are dropped."""
        return Vector((c,), lambda x, over, running, k: x[0], one=False, drops=True)

    @staticmethod
    def na_replace(c: str, value: Any) -> Vector:
        return Vector((c,), lambda x, over, running, k: F.coalesce(x[0], F.lit(value).cast(k[0])), one=False)

    @staticmethod
    def has_data(c: str) -> Vector:
        return _one(c, lambda x, k: F.count(x), keep_empty=True).then(lambda n: n > 0)

    @staticmethod
    def count(c: str) -> Vector:
        return _one(c, lambda x, k: F.count(x), keep_empty=True)

    @staticmethod
    def true_count(c: str) -> Vector:
        return _one(c, lambda x, k: F.count_if(x))

    @staticmethod
    def sum(c: str) -> Vector:
        return _one(c, lambda x, k: F.sum(x)).then(lambda n, k: n.cast(k))

    @staticmethod
    def sum_into(c: str, to: str) -> Vector:
        return _one(c, lambda x, k: F.sum(x.cast(to))).then(lambda n: n.cast(to))

    @staticmethod
    def mean(c: str) -> Vector:
        return _one(c, lambda x, k: F.avg(x.cast("double")))

    @staticmethod
    def true_freq(c: str) -> Vector:
        return _one(c, lambda x, k: F.avg(x.cast("int").cast("double")))

    @staticmethod
    def freq(c: str) -> Vector:
        """Value over the sum of values; over a zero sum, infinity or NaN."""

        def build(x, over, running, kinds):
            v, total = x[0].cast("double"), over(F.sum(x[0].cast("double")))
            zero = F.when(v > 0, float("inf")).when(v < 0, float("-inf")).otherwise(float("nan"))
            return F.when(x[0].isNotNull(), F.when(total == 0, zero).otherwise(F.try_divide(v, total)))

        return Vector((c,), build, one=False)

    @staticmethod
    def cumsum(c: str) -> Vector:
        return Vector((c,), lambda x, over, running, k: F.when(x[0].isNotNull(), running(x[0]).cast(k[0])), one=False)

    @staticmethod
    def cumsum_into(c: str, to: str) -> Vector:
        return Vector((c,), lambda x, over, running, k: F.when(x[0].isNotNull(), running(x[0].cast(to)).cast(to)), one=False)

    @staticmethod
    def add(a: str, b: str) -> Vector:
        return Vector((a, b), lambda x, over, running, k: x[0] + x[1], one=False)


def _then(self: Vector, fn: Callable) -> Vector:
    """The same, with ``fn`` applied to the result (and its type)."""
    two = fn.__code__.co_argcount == 2
    return Vector(self.columns, lambda x, over, running, k: fn(self.build(x, over, running, k), k[0]) if two else fn(self.build(x, over, running, k)), self.one, self.drops)


Vector.then = _then
