"""One query with its statements in a fixed place.

Chained calls on a Frame may come in any order, each working on what the last
one gave.  A Query takes the statements of one query and checks them: filter,
sort, select and group once at most, a filter before the sort, and a group or
a sort before what works on groups.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column

from ..frame import Frame, desc
from ..functions.na import Predicate


class Query:
    def __init__(self, frame: Frame):
        self._frame = frame
        self._done: list[str] = []
        self._choose: Callable[[Frame], Frame] = lambda out: out
        self._keys: tuple[str | desc, ...] = ()

    def _once(self, statement: str) -> None:
        if statement in self._done:
            raise ValueError(f"{statement} comes once in a query")
        self._done.append(statement)

    def filter(self, *predicates: Predicate | Column) -> Query:
        if "sort" in self._done:
            raise ValueError("filter comes before sort")
        self._once("filter")
        self._frame = self._frame.filter(*predicates)
        return self

    def sort(self, *keys: str | desc) -> Query:
        self._once("sort")
        self._frame = self._frame.sort(*keys)
        return self

    def select(self, *names: str) -> Query:
        """These columns of the result."""
        self._once("select")
        self._choose = lambda out: out.select(*names)
        return self

    def drop(self, *names: str) -> Query:
        """The columns of the result but these."""
        self._once("select")
        self._choose = lambda out: out.drop(*names)
        return self

    def group(self, *keys: str | desc) -> Query:
        self._once("group")
        self._keys = keys
        return self

    def _grouped(self, sort: bool | Sequence[str | desc]):
        if not {"group", "sort"} & set(self._done):
            raise ValueError("groups take a group or a sort")
        return self._frame.group(*self._keys, sort=sort)

    def aggregate(self, sort: bool = False, **statements: Any) -> Frame:
        return self._choose(self._grouped(sort).aggregate(**statements))

    def do(self, fn: Callable, schema: str, sort: bool = False) -> Frame:
        return self._choose(self._grouped(sort).do(fn, schema))

    def frame(self) -> Frame:
        """The rows, if the query has no groups."""
        if "group" in self._done:
            raise ValueError("a group takes an aggregate or a do")
        return self._choose(self._frame)
