"""Group and aggregate, group and do, per-group vector functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..frame import Frame, desc, keyed
from ..session import fresh, numbered
from ..session import running as running_sums


def ranked(frame: Frame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    """A DataFrame and a column that sorts the rows of a group.

    Ascending keys, and descending numbers turned around, are compared as a
    struct, so partial aggregation needs no sort; any other descending key
    takes a row number, within the group or (without keys) of the frame.
    """
    parts: list[Column] = []
    for h, down in frame.order:
        c, kind = F.col(h), frame.df.schema[h].dataType
        if not down:
            parts.append(c)
        elif isinstance(kind, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
            parts += [c.isNotNull(), F.bitwise_not(c)]
        elif isinstance(kind, T.BooleanType):
            parts += [c.isNotNull(), ~c]
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            parts += [c.isNotNull(), ~F.isnan(c), -c]
        elif not keys:
            n = fresh("rank")
            return numbered(frame.df, frame.ordering(), n), F.struct(F.col(n).alias("o0"))
        else:
            n = fresh("rank")
            w = Window.partitionBy(*(F.col(f"`{k}`") for k in keys)).orderBy(*frame.ordering())
            return frame.df.withColumn(n, F.row_number().over(w)), F.struct(F.col(n).alias("o0"))
    return frame.df, F.struct(*(p.alias(f"o{i}") for i, p in enumerate(parts))) if parts else F.struct(F.lit(0).alias("o0"))


class Grouped:
    def __init__(self, frame: Frame, keys: Sequence[str | desc], sort: bool | Sequence[str | desc]):
        """``sort``: groups in key order (True), or rows first sorted by keys
        that start with the group's; False: groups as first met.  Without keys
        the group's are those the frame is sorted by."""
        if not keys:
            if not isinstance(sort, bool):
                frame = frame.sort(*sort)
            if not frame.sorted_by:
                raise ValueError("a group takes keys, or a sorted frame")
            keys, sort = tuple(desc(k) if down else k for k, down in frame.sorted_by), False
        want = keyed(keys, frame.columns)
        self.keys = tuple(k for k, _ in want)
        if not isinstance(sort, bool):
            by = keyed(sort, frame.columns)
            if {k for k, _ in by[: len(want)]} != set(self.keys):
                raise ValueError("sort keys must start with the group's keys")
            frame, want = frame.sort(*sort), by[: len(want)]
            sort = True
        elif sort:
            want = [(k, down) for k, down in want]
        elif frame.sorted_by and {k for k, _ in frame.sorted_by[: len(want)]} == set(self.keys):
            want, sort = list(frame.sorted_by[: len(want)]), True
        self.frame, self.by, self.sorted = frame, want, bool(sort)

    def aggregate(self, **statements: Any) -> Frame:
        """One row for each group: keys, then a column for each statement.

        Without statements, the distinct keys.
        """
        f = self.frame
        for s in statements.values():
            f._need(s.column)
        if any(s.ordered for s in statements.values()) or not self.sorted:
            df, rank = ranked(f, self.keys)
        else:
            df, rank = f.df, None
        made = [s.to_column(f.types, rank).alias(f"`{n}`".strip("`")) for n, s in statements.items() if n not in self.keys]
        taken = [n for n in statements if n not in self.keys]
        if clash := [n for n in statements if n in self.keys]:
            raise ValueError(f"{clash[0]} is a key")
        hidden = [] if self.sorted else [(fresh("ord"), h, down) for h, down in f.order]
        first = [F.min_by(F.struct(F.col(h).alias("v")), rank)["v"].alias(new) for new, h, _ in hidden]
        grouped = df.groupBy(*(F.col(f"`{k}`") for k in self.keys))
        out = grouped.agg(*made, *first) if made or first else df.select(*(F.col(f"`{k}`") for k in self.keys)).distinct()
        frame = Frame(out, (*self.keys, *taken), tuple((new, down) for new, _, down in hidden), {k: v for k, v in f.levels.items() if k in self.keys})
        if self.sorted:
            frame = frame.sort(*(desc(k) if down else k for k, down in self.by))
        return frame._new(grouped_by=self.keys, aggregated=True, sorted_by=tuple(self.by) if self.sorted else ())

    def transform(self, **vectors: Any) -> Frame:
        """Do functions within each group, all rows kept."""
        return transform(self.frame, self.keys, vectors)

    def numbers(self) -> Frame:
        """The groups' keys and ``group_i``, from 0 in the order of groups."""
        groups = self.aggregate()
        if not self.sorted:
            df, rank = ranked(self.frame, self.keys)
            hidden = [(fresh("ord"), h, down) for h, down in self.frame.order]
            groups = Frame(df.groupBy(*(F.col(f"`{k}`") for k in self.keys)).agg(*(F.min_by(F.struct(F.col(h).alias("v")), rank)["v"].alias(new) for new, h, _ in hidden)), self.keys, tuple((n, d) for n, _, d in hidden))
        df = numbered(groups.df, groups.ordering(), "group_i")
        return Frame(df, (*self.keys, "group_i"), groups.order)

    def do(self, fn: Callable[[int, pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> Frame:
        """fn(group_i, keys, rows) for each group; what it returns is bound.

        keys is one row, rows the other columns in order.  A group must fit
        in a worker's memory; prefer aggregate and transform.
        """
        f, keys = self.frame, list(self.keys)
        place = numbered(f.df, f.ordering(), "__row")
        groups = self.numbers().df.select(*(F.col(f"`{k}`").alias(f"__key{i}") for i, k in enumerate(keys)), F.col("group_i").alias("__group"))
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"__key{i}"))
        rows = place.join(groups, same).select(*(F.col(f"`{c}`") for c in f.columns), "__row", "__group")
        others = [c for c in f.columns if c not in keys]
        out = T._parse_datatype_string(schema)
        full = T.StructType([*out.fields, T.StructField("__group", T.LongType()), T.StructField("__at", T.LongType())])

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("__row")
            i = int(pdf["__group"].iloc[0])
            made = fn(i, pdf[keys].head(1).reset_index(drop=True), pdf[others].reset_index(drop=True))
            return made[out.names].assign(__group=i, __at=range(len(made)))

        df = rows.groupBy("__group").applyInPandas(run, full)
        a, b = fresh("ord"), fresh("ord")
        return Frame(df.withColumnsRenamed({"__group": a, "__at": b}), tuple(out.names), ((a, False), (b, False)), {k: v for k, v in f.levels.items() if k in out.names})

    def do_vector(self, fn: Callable[[int, pd.DataFrame, pd.DataFrame], list], kind: str, name: str = "value") -> Frame:
        """fn gives a list for each group; all in a row, as a frame of one column."""
        return self.do(lambda i, k, r: pd.DataFrame({name: pd.Series(list(fn(i, k, r)), dtype=object)}), f"`{name}` {kind}")

    def do_values(self, fn: Callable[[int, pd.DataFrame, pd.DataFrame], list], kind: str) -> list:
        """As :meth:`do_vector`, a list on the driver."""
        return self.do_vector(fn, kind).get("value")


def transform(frame: Frame, keys: Sequence[str], vectors: dict[str, Any]) -> Frame:
    """Do functions in each group, or in the whole frame without keys."""
    out = frame
    whole = Window.partitionBy(*(F.col(f"`{k}`") for k in keys))
    running = whole.orderBy(*frame.ordering()).rowsBetween(Window.unboundedPreceding, 0) if frame.order else whole
    for name, v in vectors.items():
        out._need(*v.columns)
        if keys:
            df = out.df.withColumn(name, v.to_column(out.types, lambda a: a.over(whole), lambda c: F.sum(c).over(running)))
        else:
            df = _ungrouped(out, name, v)
        out = out._status(out._new(df=df, columns=out.columns if name in out.columns else (*out.columns, name)), [name])
        if v.drops:
            out = out._new(df=out.df.where(F.col(f"`{name}`").isNotNull()))
    return out


def _ungrouped(frame: Frame, name: str, v: Any) -> DataFrame:
    """A vector over all rows: totals are one broadcast row, and running sums
    add up partitions."""
    totals: dict[str, Column] = {}
    sums: dict[str, Column] = {}

    def later(into: dict[str, Column], kind: str) -> Callable[[Column], Column]:
        def add(c: Column) -> Column:
            into[made := fresh(kind)] = c
            return F.col(made)

        return add

    column = v.to_column(frame.types, later(totals, "total"), later(sums, "sum"))
    df = frame.df
    if sums:
        df = running_sums(df, frame.ordering(), sums)
    if totals:
        one = frame.df.agg(*(c.alias(n) for n, c in totals.items()))  # one row
        df = df.crossJoin(F.broadcast(one))
    return df.withColumn(name, column).drop(*totals, *sums)
