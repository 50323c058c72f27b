"""Frame: an immutable, ordered, NA-aware table over a Spark DataFrame.

Order is a list of hidden key columns that operators rewrite; it is sorted by
only where a consumer needs it, and pruned otherwise.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.na import Predicate, as_predicate
from .session import fresh, numbered, written

if TYPE_CHECKING:
    from .operators.query import Query


@dataclass(frozen=True)
class desc:  # noqa: N801
    """A key in descending order."""

    name: str


@dataclass(frozen=True)
class op:  # noqa: N801
    """A set statement: fn of the input columns where none is NA, else na."""

    fn: Callable[..., Column]
    inputs: tuple[str, ...]
    na: Any = None
    to: str | None = None


def keyed(keys: Sequence[str | desc], columns: Sequence[str]) -> list[tuple[str, bool]]:
    """(name, descending) of each key; ``_x`` is descending ``x`` if only that
    is a column."""
    out = []
    for k in keys:
        name, down = (k.name, True) if isinstance(k, desc) else (k, False)
        if name not in columns and name.startswith("_") and name[1:] in columns:
            name, down = name[1:], True
        if name not in columns:
            raise ValueError(f"no column {name}")
        out.append((name, down))
    return out


@dataclass(frozen=True)
class Frame:
    df: DataFrame  # visible columns and hidden order columns
    columns: tuple[str, ...]
    order: tuple[tuple[str, bool], ...] = ()  # hidden columns, descending
    levels: dict[str, tuple[str, ...]] = field(default_factory=dict)
    sorted_by: tuple[tuple[str, bool], ...] = ()
    grouped_by: tuple[str, ...] = ()
    aggregated: bool = False
    index_keys: tuple[str, ...] = ()
    token: str = field(default_factory=lambda: uuid.uuid4().hex)

    # ---- making frames
    @classmethod
    def of(cls, df: DataFrame, *by: str) -> Frame:
        """A frame of a DataFrame, in the order of its columns ``by``."""
        frame = cls(df, tuple(df.columns), levels=_stored(df))
        if by:
            return frame.sort(*by)._new(sorted_by=())
        seed = fresh("ord")
        return cls(df.withColumn(seed, F.monotonically_increasing_id()), tuple(df.columns), ((seed, False),), _stored(df))

    @classmethod
    def from_rows(cls, spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType, labels: dict[str, Sequence[str]] | None = None) -> Frame:
        """Of rows in their order; a column's labels check its values."""
        schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        seed = fresh("ord")
        full = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in schema), T.StructField(seed, T.LongType(), True)])
        out = cls(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], full), tuple(schema.names), ((seed, False),))
        for name, values in (labels or {}).items():
            if bad := {r[schema.names.index(name)] for r in rows} - {None, *values}:
                raise ValueError(f"{name} has values without a label: {sorted(bad)}")
            out = out.set_labels(name, values)
        return out

    @classmethod
    def from_columns(cls, spark: SparkSession, schema: str, **vectors: Any) -> Frame:
        """Of vectors; one of length 0 or 1 (or a scalar) is recycled."""
        lists = {k: list(v) if isinstance(v, (list, tuple)) else [v] for k, v in vectors.items()}
        n = max((len(v) for v in lists.values()), default=0)
        for k, v in lists.items():
            if len(v) not in (0, 1, n):
                raise ValueError(f"{k} has {len(v)} values, not {n}")
            lists[k] = v if len(v) == n else (v or [None]) * n
        names = T._parse_datatype_string(schema).names
        return cls.from_rows(spark, list(zip(*(lists[k] for k in names), strict=True)), schema)

    @classmethod
    def empty(cls, spark: SparkSession, schema: str | T.StructType = "", labels: dict[str, Sequence[str]] | None = None, capacity: int | None = None) -> Frame:
        """No rows; ``capacity`` is accepted and has no effect."""
        return cls.from_rows(spark, [], schema or T.StructType([]), labels)

    def like(self) -> Frame:
        """No rows, the same columns and labels."""
        return Frame.from_rows(self.df.sparkSession, [], self.schema, dict(self.levels))

    def _new(self, **changes: Any) -> Frame:
        return replace(self, **{"token": uuid.uuid4().hex, "index_keys": (), **changes})

    def clone(self) -> Frame:
        """The same rows and token."""
        return replace(self)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Frame) and self.token == other.token

    def __hash__(self) -> int:
        return hash(self.token)

    def reserve(self, n: int) -> Frame:
        return self

    # ---- what it has
    @property
    def schema(self) -> T.StructType:
        return T.StructType([self.df.schema[c] for c in self.columns])

    @property
    def types(self) -> dict[str, str]:
        return {c: self.df.schema[c].dataType.simpleString() for c in self.columns}

    def _need(self, *names: str) -> None:
        if missing := [n for n in names if n not in self.columns]:
            raise ValueError(f"no column {', '.join(missing)}")

    def key_column(self, name: str) -> Column:
        """What a column sorts by: its values, or the codes of its labels."""
        return self.code(name) if name in self.levels else F.col(f"`{name}`")

    def ordering(self) -> list[Column]:
        return [F.col(h).desc_nulls_first() if down else F.col(h).asc_nulls_first() for h, down in self.order]

    def _hidden(self) -> list[str]:
        return [h for h, _ in self.order]

    def to_spark(self, ordered: bool = False) -> DataFrame:
        """The visible columns; sorted only if asked for."""
        df = self.df.orderBy(*self.ordering()) if ordered and self.order else self.df
        return df.select(*(F.col(f"`{c}`").alias(c, metadata={"labels": list(self.levels[c])}) if c in self.levels else F.col(f"`{c}`") for c in self.columns))

    def collect(self) -> list[tuple]:
        return [tuple(r) for r in self.to_spark(ordered=True).collect()]

    def count(self) -> int:
        return self.df.count()

    def is_empty(self) -> bool:
        return not self.df.head(1)

    def get(self, name: str) -> list:
        """All values of a column, in order, on the driver."""
        self._need(name)
        return [r[0] for r in self.select(name).collect()]

    def apply(self, vector) -> list:
        """A Do function over the whole frame, on the driver."""
        made = self.transform(__made=vector).select("__made")
        if vector.one:
            return [r[0] for r in made.to_spark().limit(1).collect()]
        return made.get("__made")

    def is_sorted_by(self, *keys: str | desc) -> bool:
        want = tuple(keyed(keys, self.columns))
        return self.sorted_by[: len(want)] == want

    def is_grouped_by(self, *keys: str) -> bool:
        return bool(keys) and self.grouped_by[: len(keys)] == keys

    def is_aggregated_by(self, *keys: str) -> bool:
        return self.aggregated and set(self.grouped_by) == set(keys)

    # ---- columns
    def select(self, *names: str) -> Frame:
        """These columns in this order; all if none is named."""
        names = names or self.columns
        self._need(*names)
        kept = self.df.select(*(F.col(f"`{c}`") for c in names), *self._hidden())
        return self._status(self._new(df=kept, columns=tuple(names), levels={k: v for k, v in self.levels.items() if k in names}))

    retain = select

    def drop(self, *names: str) -> Frame:
        self._need(*names)
        return self.select(*(c for c in self.columns if c not in names)) if len(names) < len(self.columns) else self._new(df=self.df.select(*self._hidden()), columns=(), levels={}, sorted_by=(), grouped_by=())

    def _status(self, frame: Frame, changed: Sequence[str] = ()) -> Frame:
        """Sorted and grouped status as far as its columns are still there."""
        there = [c for c in frame.columns if c not in changed]
        kept = []
        for k in frame.sorted_by:
            if k[0] not in there:
                break
            kept.append(k)
        whole = all(c in there for c in frame.grouped_by)
        return replace(frame, sorted_by=tuple(kept), grouped_by=frame.grouped_by if whole else (), aggregated=frame.aggregated and whole)

    def rename(self, **names: str) -> Frame:
        """old=new."""
        self._need(*names)
        new = tuple(names.get(c, c) for c in self.columns)
        if len(set(new)) < len(new):
            raise ValueError("two columns of one name")
        df = self.df.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(self.columns, new, strict=True)), *self._hidden())
        return self._new(df=df, columns=new, levels={names.get(k, k): v for k, v in self.levels.items()}, sorted_by=tuple((names.get(c, c), d) for c, d in self.sorted_by), grouped_by=tuple(names.get(c, c) for c in self.grouped_by))

    def add(self, name: str, statement: Any) -> Frame:
        """A new column; it must not exist."""
        if name in self.columns:
            raise ValueError(f"column {name} exists")
        return self.set(**{name: statement})

    def set(self, where: Predicate | Column | None = None, **statements: Any) -> Frame:
        """New or replaced columns, one statement after another.

        A statement is a constant, a Column, an :class:`op`, or a list with a
        value for each row (or one).  With ``where``, evaluated once before,
        other rows keep the old value, or have NA in a new column.
        """
        out, chosen = self, None
        if where is not None:
            chosen = fresh("where")
            out = self._new(df=self.df.withColumn(chosen, as_predicate(where).build(self.types)))
        for name, s in statements.items():
            if isinstance(s, list) and len(s) != 1:
                out, column = out._with_vector(s)
            elif isinstance(s, op):
                out._need(*s.inputs)
                cols = [F.col(f"`{c}`") for c in s.inputs]
                known = F.lit(True)
                for c in cols:
                    known = known & c.isNotNull()
                column = F.when(known, s.fn(*cols)).otherwise(F.lit(s.na))
                column = column.cast(s.to) if s.to else column
            else:
                s = s[0] if isinstance(s, list) else s
                column = s if isinstance(s, Column) else F.lit(s).cast(out.types[name]) if name in out.columns else F.lit(s)
            if chosen:
                column = F.when(F.col(chosen), column).otherwise(F.col(f"`{name}`") if name in out.columns else F.lit(None))
            labels = {k: v for k, v in out.levels.items() if k != name or out.df.select(column.alias("x")).schema[0].dataType == T.StringType()}
            out = out._status(out._new(df=out.df.withColumn(name, column), columns=out.columns if name in out.columns else (*out.columns, name), levels=labels), [name])
        return out._new(df=out.df.drop(chosen)) if chosen else out

    def _with_vector(self, values: list) -> tuple[Frame, Column]:
        place, hidden = fresh("row"), fresh("value")
        df = numbered(self.df, self.ordering(), place)
        if (n := df.count()) != len(values):
            raise ValueError(f"{len(values)} values for {n} rows")
        side = self.df.sparkSession.createDataFrame(list(enumerate(values)), f"`{place}_` long, `{hidden}` {_kind(values)}")
        joined = df.join(side, F.col(place) == F.col(f"{place}_")).drop(place, f"{place}_")
        return self._new(df=joined), F.col(hidden)

    def inject(self, source: Frame, **statements: Any) -> Frame:
        """Columns from constants or Do functions of another frame; of one
        value they are recycled, else placed row by row."""
        out = self
        for name, s in statements.items():
            if not hasattr(s, "one"):
                out = out.set(**{name: s})
                continue
            made = source.transform(__made=s).select("__made")
            if s.one:
                one = made.df.limit(1).select(F.col("__made").alias(name))  # one row
                left = out.df.drop(name) if name in out.columns else out.df
                columns = out.columns if name in out.columns else (*out.columns, name)
                out = out._new(df=left.crossJoin(F.broadcast(one)), columns=columns)
            else:
                from .operators.bind import cbind

                columns = out.columns if name in out.columns else (*out.columns, name)
                left = out.drop(name) if name in out.columns else out
                out = cbind(left, made.rename(__made=name)).select(*columns)
        return out

    # ---- rows
    def filter(self, *predicates: Predicate | Column) -> Frame:
        """Rows for which all predicates hold."""
        df = self.df
        for p in predicates:
            df = df.filter(as_predicate(p).build(self.types))
        return self._new(df=df)

    def sort(self, *keys: str | desc) -> Frame:
        """By keys, NA first in both directions; ties keep their order."""
        want = keyed(keys, self.columns)
        if want and self.sorted_by[: len(want)] == tuple(want):
            return self
        df, hidden = self.df, []
        for name, down in want:
            h = fresh("ord")
            df = df.withColumn(h, self.key_column(name))
            hidden.append((h, down))
        return self._new(df=df, order=(*hidden, *self.order), sorted_by=tuple(want), grouped_by=(), aggregated=False)

    def numbered(self, name: str) -> DataFrame:
        return numbered(self.df, self.ordering(), name)

    def slice(self, start: int, n: int) -> Frame:
        df = self.to_spark(ordered=True)
        return Frame.of(df.offset(start).limit(n))._new(levels=self.levels) if not self.order else self._new(df=self.df.orderBy(*self.ordering()).offset(start).limit(n))

    def take_rows(self, positions: Sequence[int]) -> Frame:
        """Rows by place, in the order asked for, repeats allowed."""
        place, seed = fresh("row"), fresh("ord")
        want = self.df.sparkSession.createDataFrame([(p, i) for i, p in enumerate(positions)], f"`{place}_` long, `{seed}` long")
        df = self.numbered(place).join(want, F.col(place) == F.col(f"{place}_")).select(*(F.col(f"`{c}`") for c in self.columns), seed)
        return self._new(df=df, order=((seed, False),), sorted_by=(), grouped_by=(), aggregated=False)

    def cell(self, name: str, row: int) -> Any:
        self._need(name)
        got = self.slice(row, 1).select(name).collect()
        if not got:
            raise IndexError(row)
        return got[0][0]

    def set_cell(self, name: str, row: int, value: Any) -> Frame:
        self._need(name)
        place = fresh("row")
        df = self.numbered(place)
        column = F.when(F.col(place) == row, F.lit(value).cast(self.types[name])).otherwise(F.col(f"`{name}`"))
        return self._new(df=df.withColumn(name, column).drop(place))

    # ---- groups
    def group(self, *keys: str | desc, sort: bool | Sequence[str | desc] = False):
        from .operators.group import Grouped

        return Grouped(self, keys, sort)

    def transform(self, **vectors: Any) -> Frame:
        """Do functions over all rows as one group."""
        from .operators.group import transform

        return transform(self, (), vectors)

    def pivot(self, keys: Sequence[str | desc], on: str, fill=None, kind: str = "count", labels: Sequence[str] | None = None, sort: bool | Sequence[str | desc] = False) -> Frame:
        from .operators.pivot import pivot

        return pivot(self, keys, on, fill, kind, labels, sort)

    # ---- factors
    def set_labels(self, name: str, labels: Sequence[str]) -> Frame:
        self._need(name)
        if len(set(labels)) < len(labels) or len(labels) > 65536:
            raise ValueError("labels must differ, and be 65536 at most")
        return self._new(levels={**self.levels, name: tuple(labels)})

    def labels(self, name: str) -> list[str]:
        return list(self.levels[name])

    def level_codes(self, name: str) -> dict[str, int]:
        return {label: i for i, label in enumerate(self.levels[name])}

    def copy_labels(self, name: str, other: Frame, from_name: str | None = None) -> Frame:
        return self.set_labels(name, other.labels(from_name or name))

    def code(self, name: str) -> Column:
        place = F.array_position(F.array(*(F.lit(x) for x in self.levels[name])), F.col(f"`{name}`"))
        return F.when(place > 0, (place - 1).cast("int"))

    def factorize(self, name: str) -> Frame:
        """Labels in order of first encounter; a boolean has false, true."""
        from .operators.pivot import categories

        text = F.col(f"`{name}`").cast("string")
        found = ["false", "true"] if self.types[name] == "boolean" else [str(v) for v in categories(self, name, ()) if v is not None]
        return self._new(df=self.df.withColumn(name, text)).set_labels(name, found)

    # ---- index
    def index(self, *keys: str) -> Frame:
        """Writes rows clustered by key to the shared folder as Parquet, so that
        a lookup reads the files and row groups whose range holds its keys."""
        self._need(*keys)
        by = [F.col(f"`{k}`").asc_nulls_first() for k in keys]
        frame = self if self.is_grouped_by(*keys) else self.sort(*keys)
        n = int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        df = written(frame.df.repartitionByRange(n, *by).sortWithinPartitions(*by), "index")
        return replace(frame._new(df=df), index_keys=tuple(keys), grouped_by=tuple(keys))

    def lookup(self, **values: Any) -> Frame:
        """Rows whose keys are these values (None is NA)."""
        if not self.index_keys or set(values) != set(self.index_keys):
            raise ValueError(f"indexed by {self.index_keys}, not by {tuple(values)}")
        hit = F.lit(True)
        for k, v in values.items():
            hit = hit & (F.col(f"`{k}`").isNull() if v is None else F.col(f"`{k}`") == F.lit(v))
        return self._new(df=self.df.filter(hit))

    # ---- output
    def show_text(self, rows: int = 20, width: int = 25) -> str:
        """Size, names with types, and the first rows, NA for null."""
        total = self.count()
        got = [["NA" if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in r] for r in self.to_spark(ordered=True).limit(rows).collect()]
        heads = [f"{c} <{'factor' if c in self.levels else t}>" for c, t in self.types.items()]
        widths = [min(width, max(map(len, [h, *(r[i] for r in got)]))) for i, h in enumerate(heads)]
        line = lambda cells: " ".join(c.ljust(w) if len(c) <= w else c[: w - 1] + "…" for c, w in zip(cells, widths, strict=True))
        out = [f"Frame: {total} rows x {len(self.columns)} columns", line(heads), " ".join("-" * w for w in widths), *map(line, got)]
        return "\n".join(out + ["..."] * (total > rows))

    def write_text(self, path: str, sep: str = "\t", header: bool = False) -> None:
        from .sources.text import write_text

        write_text(self, path, sep, header)

    def write_parquet(self, path: str) -> None:
        self.to_spark(ordered=bool(self.sorted_by)).write.mode("overwrite").parquet(path)

    def query(self, *steps: Callable[[Frame], Frame]) -> Frame | Query:
        """Steps one after another; without any, a :class:`Query`."""
        if not steps:
            from .operators.query import Query

            return Query(self)
        out = self
        for step in steps:
            out = step(out)
        return out


def _stored(df: DataFrame) -> dict[str, tuple[str, ...]]:
    return {f.name: tuple(f.metadata["labels"]) for f in df.schema if f.metadata and "labels" in f.metadata}


def _kind(values: list) -> str:
    known = [v for v in values if v is not None]
    if not known:
        return "string"
    first = next((v for v in known if isinstance(v, float)), known[0])
    return "boolean" if isinstance(first, bool) else "int" if isinstance(first, int) and all(abs(v) < 1 << 31 for v in known) else "long" if isinstance(first, int) else "double" if isinstance(first, float) else "string"
