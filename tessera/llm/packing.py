"""Hierarchical residual best-fit packing of token sequences.

Texts are encoded and cut into pieces of at most ``capacity`` tokens.  Groups
of pieces are packed by best fit, longest first; bins that are nearly full are
final.  The rest go up a tree: the underfull bins of ``FAN_IN`` groups become
items of one best-fit round, and so on to the root.  Bins that are too many
for one task are dealt out to several, at the root until that merges no more.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import cut, map_arrow, require
from .pool import Pool, spread
from .pool import shared as pool_of

CAPACITY = 4096
END = 1
#: Pieces in one group of the lowest level, about.
GROUP = 2000
FAN_IN = 8
#: A bin is final if no more than this share of it is free.
NEARLY_FULL = 1 / 128
#: Underfull bins that one task may get; nodes with more are dealt to several.
MAX_OPEN = 100_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def word_pool(definition: str) -> Pool:
    """Remembers the ids of units, which the tokenizer takes one by one."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    mark = max(special, key=special.get) if special else None

    def alone(texts: list[str]) -> list[list[int]]:
        return [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]

    def encode(units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [u.decode() for u in units]
        odd = [i for i, t in enumerate(texts) if mark is None or "<|" in t]
        if odd:
            each = alone(texts)
            return np.array([i for ids in each for i in ids], np.int32), np.array([len(ids) for ids in each], np.int64)
        # One call for many units, with a special token between them.
        flat, lengths = [], []
        for i in range(0, len(texts), 500):
            part = texts[i : i + 500]
            ids = np.array(tokenizer.encode(mark.join(part), add_special_tokens=False).ids, np.int32)
            at = np.flatnonzero(ids == special[mark])
            if len(at) != len(part) - 1:
                raise ValueError("units can't be told apart")
            flat.append(np.delete(ids, at))
            lengths.append(np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1)
        return np.concatenate(flat), np.concatenate(lengths)

    return Pool(encode)


_KIND = np.zeros(256, np.uint8)  # 0: beyond ASCII or a control character
_KIND[0x21:0x7F] = 3
_KIND[0x30:0x3A] = 2
_KIND[0x41:0x5B] = _KIND[0x61:0x7B] = 1


def units(block: K.Block) -> tuple[K.Block, np.ndarray, np.ndarray, np.ndarray]:
    """Parts of the texts that the tokenizer encodes alone: starts, ends,
    text numbers, and the block that they lie in.

    It drops white space, lowers case, and never joins an ASCII letter, digit
    or other sign to one of another kind, nor two digits, but for an
    apostrophe before letters.  Words with ``<|``, the start of a special
    token, stay whole and as they are.
    """
    begins, ends, of = block.runs(K.NOT_SPACE)
    d = block.data
    marked = np.flatnonzero((d[:-1] == 0x3C) & (d[1:] == 0x7C)) if len(d) > 1 else np.zeros(0, np.int64)
    if not len(marked):
        block = block.lowered()
    kind = _KIND[d]
    a, b = kind[:-1], kind[1:]
    split = np.flatnonzero((a > 0) & (b > 0) & ((a != b) | (b == 2)) & ~((d[:-1] == 0x27) & (b == 1))) + 1
    split = split[~np.isin(split, block.starts)] if len(split) else split
    word = np.searchsorted(begins, split, side="right") - 1
    if len(marked):
        keep = ~np.isin(word, np.searchsorted(begins, marked, side="right") - 1)
        split, word = split[keep], word[keep]
    begins = np.sort(np.concatenate([begins, split]))
    ends = np.sort(np.concatenate([ends, split]))
    return block, begins, ends, np.sort(np.concatenate([of, of[word]]))


def block_ids(pool: Pool, block: K.Block) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each text and ``END`` after it, in a row; ids of each text."""
    block, begins, ends, of = units(block)
    ids, lengths = pool.lookup(block, begins, ends)
    counts = np.bincount(of, weights=lengths, minlength=block.n).astype(np.int64)
    out = np.full(len(ids) + block.n, END, np.uint32)
    stops = np.cumsum(counts + 1) - 1
    keep = np.ones(len(out), bool)
    keep[stops] = False
    out[keep] = ids
    return out, counts + 1


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32.

    ``tokenizer`` is a path on the driver; the definition itself is sent to
    the executors.  Null texts count as empty and have the end token alone;
    repeated rows have pieces each; other columns are left out.
    """
    require(docs, key, text)
    definition = Path(tokenizer).read_text()
    shared = docs.sparkSession.sparkContext.broadcast(definition)  # one vocabulary file

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pool_of(shared.value, lambda: word_pool(shared.value))
        for batch in batches:
            for block in K.blocks(batch.column(1)):
                ids, counts = block_ids(pool, block)
                n = -(-counts // capacity)
                piece = spread(np.zeros(block.n, np.int64), n)
                of = np.repeat(np.arange(block.n), n)
                start = piece * capacity
                length = np.minimum(counts[of] - start, capacity)
                at = (np.cumsum(counts) - counts)[of] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of + block.first)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_arrow(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")), cut_up, PIECE)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and how much of each bin is filled.

    Items go longest first into the bin with the least room that has enough.
    """
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)
    room: list[int] = []
    by_room: dict[int, list[int]] = {}
    mask = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = mask >> need
        if fits:
            free = need + (fits & -fits).bit_length() - 1
            stack = by_room[free]
            b = stack.pop()
            if not stack:
                mask ^= 1 << free
        else:
            free, b = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - free
        room[b] = free - need
        if free > need:
            stack = by_room.setdefault(free - need, [])
            if not stack:
                mask |= 1 << (free - need)
            stack.append(b)
    return bins, offsets, capacity - np.asarray(room, np.int64)


def _merger(capacity: int):
    """Packs open bins of one node of the tree.  A sequence is named by the
    first bin it holds."""
    names = ["bin", "seq", "shift", "fill", "node"]

    def merge(t: pa.Table) -> pa.Table:
        seqs, first, back = np.unique(t.column("seq").to_numpy(), return_index=True, return_inverse=True)
        bins, offsets, fill = best_fit(t.column("fill").to_numpy()[first], capacity)
        name = seqs[np.unique(bins, return_index=True)[1]]
        return pa.table([t.column("bin"), pa.array(name[bins[back]]), pa.array(t.column("shift").to_numpy() + offsets[back]), pa.array(fill[bins[back]]), t.column("node")], names)

    return merge


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``items`` (a column ``length`` of 1 to ``capacity`` and any others)
    with sequence_id and offset.

    Each row is one item, repeated rows too.  Columns of ``items`` may have any
    names; a sequence_id or offset that is there is replaced.  Empty input
    gives no rows.
    """
    require(items, "length")
    full = capacity - int(capacity * NEARLY_FULL)
    given = [c for c in items.columns if c not in ("sequence_id", "offset")]
    own = [F.col(f"c{i}").alias(c) for i, c in enumerate(given)]
    size = f"c{given.index('length')}"
    items = items.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(given)))
    # checkpointed first: the row numbers must not change if a task is repeated
    items = cut(items.withColumn("slot", F.monotonically_increasing_id()))
    groups = max(1, -(-items.count() // group))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", node long, bin long, offset long, fill long"

    def lowest(t: pa.Table) -> pa.Table:
        node = t.column("node")[0].as_py()
        order = np.argsort(t.column("slot").to_numpy())
        t = t.take(pa.array(order))
        bins, offsets, fill = best_fit(t.column(size).to_numpy(), capacity)
        names = [c for c in t.column_names if c != "node"]
        return pa.table([*(t.column(c) for c in names), pa.array(np.full(len(t), node)), pa.array((node << 24) + bins), pa.array(offsets), pa.array(fill[bins])], [*names, "node", "bin", "offset", "fill"])

    # Rows are dealt out by their number, so groups are even.
    packed = cut(items.withColumn("node", (F.col("slot") % F.lit(1 << 33) + F.shiftright("slot", 33)) % groups).groupBy("node").applyInArrow(lowest, schema))
    openings = packed.where(F.col("fill") < full).groupBy("bin").agg(F.first("fill").alias("fill"), F.first("node").alias("node"))
    level = openings.select("bin", F.col("bin").alias("seq"), F.lit(0).cast("long").alias("shift"), "fill", "node")
    done = left = None
    depth, again = 0, groups > 1
    while again:
        depth += 1
        groups = -(-groups // FAN_IN)
        level = level.withColumn("node", F.expr(f"node div {FAN_IN}"))
        most = level.groupBy("node").count().agg(F.max("count")).first()[0] or 0
        # dealt by a hash, so each task gets all kinds of fill, others each round
        parts = 1 if most <= MAX_OPEN else -(-2 * most // MAX_OPEN)
        level = level.withColumn("part", F.pmod(F.xxhash64("seq", F.lit(depth)), F.lit(parts)))
        level = cut(level.groupBy("node", "part").applyInArrow(_merger(capacity), "bin long, seq long, shift long, fill long, node long"))
        again = groups > 1
        if groups == 1 and parts > 1:
            before, left = left, level.where(F.col("fill") < full).agg(F.countDistinct("seq")).first()[0]
            again = before is None or left < before
        final = level.where(F.col("fill") >= full) if again else level
        done = final if done is None else done.unionByName(final)
        level = level.where(F.col("fill") < full)
    if done is None:
        return packed.select(*own, F.col("bin").alias("sequence_id"), "offset")
    moved = done.select(F.col("bin").alias("from_bin"), "seq", "shift")
    placed = packed.join(moved, F.col("bin") == F.col("from_bin"), "left")
    return placed.select(*own, F.coalesce("seq", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
