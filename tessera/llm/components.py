"""Connected components of links, by rounds of contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, release

#: How often pointers to pointers are followed before it is asked whether
#: there are more.
JUMPS = 2
#: Links that one task takes at once; more go through rounds until so many are left.
FEW = 1 << 20


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) from columns a, b.

    ``edges`` is read several times, so it should be checkpointed.  At most
    FEW links are taken by one task (:func:`_at_once`).  More go through
    rounds: in a round every node points to the least of itself and its
    neighbours, and follows pointers to their end, twice as far each time.
    Nodes that arrive together become one, so each round at least halves them,
    and only links between different ones go on.  The least node of a
    component always stays itself, so it is what all arrive at.  Rounds use
    joins and partial minima only, and each is checkpointed and its plans let
    go, so that the driver holds those of one round.  No edges, no rows; null
    nodes are passed over.
    """
    spark = edges.sparkSession
    both = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    rounds = []
    if both.count() > FEW:
        both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        while both.count() > 2 * FEW:  # each link in both directions
            to = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to")))
            further = True
            while further:
                for _ in range(JUMPS):
                    on = to.select(F.col("node").alias("to"), F.col("to").alias("on"))
                    to = to.join(on, "to").select("node", F.col("on").alias("to"))
                to = cut(to)
                ends = to.select(F.col("node").alias("to"), F.col("to").alias("on"))
                further = to.join(ends, "to").where(F.col("to") != F.col("on")).count() > 0
            left, right = (to.select(F.col("node").alias(end), F.col("to").alias(f"to_{end}")) for end in ("a", "b"))
            both = both.join(left, "a").join(right, "b").where("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
            both = cut(both.distinct())
            rounds.append(to)
            release(spark)
    rounds.append(cut(_at_once(both.where("a < b") if rounds else both)))
    labels = rounds[0].withColumnRenamed("to", "label")
    for to in rounds[1:]:
        labels = labels.join(to.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    labels = cut(labels) if len(rounds) > 1 else labels
    release(spark)
    return labels


def _at_once(edges: DataFrame) -> DataFrame:
    """node, to (the least node of its component), from one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            a.append(batch.column(0).to_numpy())
            b.append(batch.column(1).to_numpy())
        nodes, to = least(np.concatenate(a), np.concatenate(b))
        for i in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 16)]), pa.array(to[i : i + (1 << 16)])], ["node", "to"])

    return map_arrow(edges.coalesce(1), run, "node long, to long")


def least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct nodes of the links (a, b), sorted, and the least node of
    each one's component.  Roots point to their least neighbour, pointers are
    followed to their end, and links between different roots go on."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    to = np.arange(len(nodes))
    while len(x):
        np.minimum.at(to, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(on := to[to], to):
            to = on
        x, y = to[x], to[y]
        apart = x != y
        x, y = x[apart], y[apart]
    return nodes, nodes[to]
