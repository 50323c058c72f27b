"""Joins of two or more frames on equally named keys; NA equals NA."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frame import Frame, desc, keyed
from ..functions.na import Predicate
from ..session import fresh

#: Rows of one side, of one key, that meet in one place; keys with more pairs
#: than HEAVY are cut into such blocks.
BLOCK = 1 << 11
HEAVY = 1 << 22


def join(frames: Sequence[Frame], keys: Sequence[str | desc], how: str = "inner", cols: Sequence[str] | None = None, where: Predicate | Column | None = None, sort: bool = False) -> Frame:
    """inner, left or outer join, from left to right.

    ``cols`` names the other columns that are kept (all by default); they must
    differ between frames.  ``where`` filters each frame before.  ``sort``
    puts rows in key order, which an outer join needs; otherwise rows are in
    the order of the left frame, then the right.

    The rows of each key are counted before.  If some key has more than HEAVY
    pairs, its rows are cut into blocks of about BLOCK on each side, and each
    two blocks meet in a task of their own rather than all in the key's.
    """
    if len(frames) < 2:
        raise ValueError("a join takes two frames or more")
    if how not in ("inner", "left", "outer"):
        raise ValueError(f"no join {how}")
    if how == "outer" and not sort:
        raise ValueError("an outer join must be sorted")
    by = keyed(keys, frames[0].columns)
    names = [k for k, _ in by]
    if not names:
        raise ValueError("a join takes a key")
    for f in frames:
        f._need(*names)
    if cols is not None and (lost := [c for c in cols if not any(c in f.columns for f in frames)]):
        raise ValueError(f"no column {', '.join(lost)}")
    kept = []
    for f in frames:
        f = f if where is None else f.filter(where)
        kept.append(f.select(*names, *(c for c in f.columns if c not in names and (cols is None or c in cols))))
    others = [c for f in kept for c in f.columns if c not in names]
    if len(set(others)) < len(others):
        raise ValueError("columns other than keys must differ")
    for k in names:
        if len({f.types[k] for f in kept}) > 1:
            raise ValueError(f"key {k} has different types")
    out, had = kept[0], _counts(kept[0], names)
    for f in kept[1:]:
        heavy, had = _pairs(had, _counts(f, names), how)
        out = _two(out, f, names, how, None if heavy.isEmpty() else heavy)
    return out.sort(*(desc(k) if down else k for k, down in by)) if sort else out


def _counts(f: Frame, names: list[str]) -> DataFrame:
    """The rows of each key: columns key0, key1 and on, and n."""
    return f.df.groupBy(*(F.col(f"`{k}`").alias(f"key{i}") for i, k in enumerate(names))).agg(F.count(F.lit(1)).cast("double").alias("n"))


def _pairs(left: DataFrame, right: DataFrame, how: str) -> tuple[DataFrame, DataFrame]:
    """Keys with too many pairs and the blocks of each side, n_left and
    n_right; and the joined rows of each key.  The first are fewer than one
    for each BLOCK rows."""
    keys = left.columns[:-1]
    other = right.select(*(F.col(k).alias(f"of_{k}") for k in keys), F.col("n").alias("m"))
    both = left.join(other, _same((k, f"of_{k}") for k in keys), {"inner": "inner", "left": "left", "outer": "full"}[how])
    blocks = (F.ceil(F.col(c) / BLOCK).cast("int").alias(name) for c, name in (("n", "n_left"), ("m", "n_right")))
    heavy = both.where(F.col("n") * F.col("m") > HEAVY).select(*keys, *blocks)
    one = F.lit(1.0)
    made = both.select(*(F.when(F.col("n").isNull(), F.col(f"of_{k}")).otherwise(F.col(k)).alias(k) for k in keys), (F.coalesce("n", one) * F.coalesce("m", one)).alias("n"))
    return heavy, made


def _same(pairs) -> Column:
    return reduce(lambda x, y: x & y, (F.col(x).eqNullSafe(F.col(y)) for x, y in pairs))


def _dealt(df: DataFrame, keys: list[str], order: list[str], heavy: DataFrame, own: str, other: str) -> tuple[DataFrame, str, str]:
    """``df`` with each row of a heavy key in one block of its side, once for
    each block of the other; the columns of the place and whether it is heavy."""
    place, marked = fresh("place"), fresh("heavy")
    blocks = {own: fresh("own"), other: fresh("other")}
    names = {k: fresh("of") for k in heavy.columns if k not in blocks}
    columns = df.columns
    rows = order or [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    df = df.join(F.broadcast(heavy.withColumnsRenamed(names | blocks)), _same(zip(keys, names.values(), strict=True)), "left")
    n_own, n_other = (F.coalesce(F.col(blocks[c]), F.lit(1)) for c in (own, other))
    mine = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in rows)), n_own).cast("int")
    each = F.explode(F.sequence(F.lit(0), n_other - 1)).alias(blocks[other])
    df = df.select(*(F.col(f"`{c}`") for c in columns), F.col(blocks[own]).isNotNull().alias(marked), mine.alias(blocks[own]), each)
    # null fields of structs are equal; both sides have one type, all nullable, and no floats, or else they'd be dealt again
    floats = {k for k in keys if isinstance(df.schema[k].dataType, T.FractionalType) and not isinstance(df.schema[k].dataType, T.DecimalType)}
    fields = [((F.col(k) + F.lit(0.0)).cast("string") if k in floats else F.col(k)).alias(f"key{i}") for i, k in enumerate(keys)]
    at = F.struct(*fields, *(F.col(blocks[n]).alias(n) for n in ("n_left", "n_right")))
    types = [(f"key{i}", T.StringType() if k in floats else df.schema[k].dataType) for i, k in enumerate(keys)]
    at = at.cast(T.StructType([T.StructField(n, t, True) for n, t in (*types, ("n_left", T.IntegerType()), ("n_right", T.IntegerType()))]))
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    return df.withColumn(place, at).drop(*blocks.values()).repartition(parts, place), place, marked


def _two(left: Frame, right: Frame, names: list[str], how: str, heavy: DataFrame | None = None) -> Frame:
    ours = {h: fresh("ord") for h, _ in left.order}
    theirs = {h: fresh("ord") for h, _ in right.order}
    keys = [(fresh("key"), fresh("key")) for _ in names]
    plain_l = [c for c in left.columns if c not in names]
    plain_r = [c for c in right.columns if c not in names]
    a = left.df.select(*(F.col(f"`{k}`").alias(x) for k, (x, _) in zip(names, keys, strict=True)), *(F.col(f"`{c}`") for c in plain_l), *(F.col(h).alias(n) for h, n in ours.items()))
    b = right.df.select(*(F.col(f"`{k}`").alias(y) for k, (_, y) in zip(names, keys, strict=True)), *(F.col(f"`{c}`") for c in plain_r), *(F.col(h).alias(n) for h, n in theirs.items()))
    kind = {"inner": "inner", "left": "left", "outer": "full"}[how]
    if heavy is None:
        both = a.join(b, _same(keys), kind)
    else:
        a, here, mine = _dealt(a, [x for x, _ in keys], list(ours.values()), heavy, "n_left", "n_right")
        b, there, yours = _dealt(b, [y for _, y in keys], list(theirs.values()), heavy, "n_right", "n_left")
        both = a.join(b.hint("merge"), F.col(here) == F.col(there), kind)
        # a heavy row has its pairs; it is alone only where it meets an empty block
        alone = (F.col(mine) & F.col(yours).isNull()) | (F.col(yours) & F.col(mine).isNull())
        both = both if how == "inner" else both.where(~F.coalesce(alone, F.lit(False)))
    made = [(F.coalesce(F.col(x), F.col(y)) if how == "outer" else F.col(x)).alias(k) for k, (x, y) in zip(names, keys, strict=True)]
    columns = (*names, *plain_l, *plain_r)
    df = both.select(*made, *(F.col(f"`{c}`") for c in (*plain_l, *plain_r)), *ours.values(), *theirs.values())
    order = (*((ours[h], d) for h, d in left.order), *((theirs[h], d) for h, d in right.order))
    return Frame(df, columns, order, {k: v for k, v in {**right.levels, **left.levels}.items() if k in columns})
