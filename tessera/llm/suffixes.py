"""Removal of repeated passages with a sampled, range-partitioned suffix array.

Every byte that a ``window``-byte string covers goes, if that string also
starts in a document with a smaller id.

Sorting every suffix of a large corpus would move each text ``window`` times.
Only sampled suffixes are sorted: in each window the ``GRAM``-byte gram with
the least hash is an anchor, so two equal windows have the same anchor at the
same place, and it is enough to compare the ``window - GRAM`` bytes before and
after equal anchors.  The steps are:

1. texts are put in chunks (a written table, read twice);
2. each chunk finds its anchors and merges equal contexts.  A window shared
   by two documents holds half of the bytes around its anchor on one side at
   least, so contexts of which neither half stands in another document can't
   matter: chunks exchange short hashes of the halves and drop those contexts
   (a chance agreement keeps a context, and costs nothing else);
3. the contexts that are left are dealt out to buckets by splitters sampled
   from their leading bytes;
4. a bucket sorts its contexts by what follows and, within one anchor, by
   what precedes (multikey quicksort, eight bytes a step), compares
   neighbours, also those from different chunks, and finds for each window
   the least document.  Splitters fall between different anchors, so no
   comparison goes beyond a bucket's end;
5. verdicts go back to the chunks that sent the contexts.

A context that stands in many documents is sent once from each chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import numbered
from . import kernel as K
from .common import cut, map_arrow, prepare, require, trim

WINDOW = 50
GRAM = 16
CHUNK = 2 << 20
#: Bytes of text for each bucket, about.
BUCKET = 16 << 20
#: Contexts that a chunk gives for the choice of splitters, and one in how
#: many chunks gives them (all do if there are few).
SAMPLE = 256
SHARE = 8

_NULL_ID = (1 << 63) - 1  # a null id counts as the largest


def _ipc(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as writer:
        for b in batches:
            writer.write_batch(b)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())


def pack_chunks(docs: DataFrame, key: str, text: str, chunk: int = CHUNK, carry: bool = False) -> DataFrame:
    """chunk, n_bytes, ids, starts, data, rest: many texts in a row,
    compressed; with ``carry``, rest has their other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        press = zstandard.ZstdCompressor(level=3)
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        parts: list[bytes] = []
        rest: list[pa.RecordBatch] = []
        held = made = 0

        def flush() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + made]), pa.array([held], pa.int64()), pa.array([np.concatenate(ids).tobytes()]), pa.array([starts.astype(np.int64).tobytes()]), pa.array([press.compress(b"".join(parts))]), pa.array([_ipc(rest) if carry else None], pa.binary())],
                ["chunk", "n_bytes", "ids", "starts", "data", "rest"],
            )

        for batch in batches:
            for block in K.blocks(batch.column(1), chunk // 4):
                ids.append(batch.column(0).slice(block.first, block.n).fill_null(_NULL_ID).to_numpy())
                sizes.append(np.diff(block.starts))
                parts.append(block.data.tobytes())
                if carry:
                    rest.append(pa.RecordBatch.from_arrays([c.slice(block.first, block.n) for c in batch.columns[2:]], [f"c{i}" for i in range(len(batch.columns) - 2)]))
                held += len(block.data)
                if held >= chunk or sum(map(len, ids)) >= 65536:
                    yield flush()
                    ids, sizes, parts, rest, held, made = [], [], [], [], 0, made + 1
        if ids:
            yield flush()

    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(c for c in docs.columns if c != text)] if carry else []
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"), *others)
    return map_arrow(rows, run, "chunk long, n_bytes long, ids binary, starts binary, data binary, rest binary")


def _open(ids: bytes, starts: bytes, data: bytes) -> tuple[np.ndarray, K.Block]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    return np.frombuffer(ids, np.int64), K.Block(np.frombuffer(raw, np.uint8), np.frombuffer(starts, np.int64))


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """32-bit hashes of all grams (a power of two bytes); fewer than bytes."""
    h = data.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15)
    span, factor = 1, 0x85EBCA6B
    while span < gram:
        h = (h[: len(h) - span] * np.uint32(factor)) ^ (h[span:] >> np.uint32(5)) ^ (h[span:] << np.uint32(9))
        span, factor = 2 * span, (factor * 0xC2B2AE35 + 2) & 0xFFFFFFFF | 1
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) | np.uint32(1)


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over x[i : i + width] for each i."""
    span = 1
    while 2 * span <= width:
        x = pick(x[: len(x) - span], x[span:])
        span *= 2
    if span < width:
        x = pick(x[: len(x) - (width - span)], x[width - span :])
    return x


def anchors(block: K.Block, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the least grams of all windows inside texts; their texts."""
    n, around = len(block.data), window - gram + 1
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = _gram_hashes(block.data, gram)
    least = _slide(h, around, np.minimum)  # by start of window
    flags = np.zeros(n + 1, np.int32)
    ends = block.starts[1:]
    np.add.at(flags, np.maximum(block.starts[:-1], ends - window + 1), 1)
    np.add.at(flags, ends, -1)
    least[np.cumsum(flags, dtype=np.int32)[: len(least)] > 0] = 0  # the window leaves its text
    del flags
    wide = np.concatenate([np.zeros(around - 1, np.uint32), least, np.zeros(around - 1, np.uint32)])
    most = _slide(wide, around, np.maximum)  # over windows that hold the gram
    at = np.flatnonzero((h == most[: len(h)]) & (most[: len(h)] > 0))
    return at, block.text_of(at)


def _view(data: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    """Copies of ``width`` bytes from each position."""
    if not len(at):
        return np.zeros((0, width), np.uint8)
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, width)[at])


class Contexts:
    """The distinct contexts of a chunk's anchors, in a fixed order."""

    def __init__(self, ids: np.ndarray, block: K.Block, window: int, gram: int):
        self.side = side = window - gram
        self.width = width = 2 * side + gram
        at, of = anchors(block, window, gram)
        self.at, self.doc = at, ids[of]
        begin, end = block.starts[of], block.starts[of + 1]
        self.lo = np.minimum(side, at - begin)
        self.hi = np.minimum(side, end - at - gram)
        if len(at):
            with np.errstate(over="ignore"):
                h = K.mix(block.hashes(at - self.lo, at + gram + self.hi) + (self.lo * 256 + self.hi).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        else:
            h = np.zeros(0, np.uint64)
        h, first, back = np.unique(h, return_index=True, return_inverse=True)
        padded = np.concatenate([np.zeros(side, np.uint8), block.data, np.zeros(side + gram + 8, np.uint8)])
        start = at[first]
        lead = _view(padded, 16, start + side)
        lead[np.arange(16) >= (gram + self.hi[first])[:, None]] = 0
        lead = lead.view(">u8").astype(np.uint64)
        order = np.lexsort((h, lead[:, 1], lead[:, 0]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.lead, start, first = lead[order], start[order], first[order]
        self.row_lo, self.row_hi = self.lo[first], self.hi[first]
        self.rows = _view(padded, width, start)
        for i in np.flatnonzero((self.row_lo < side) | (self.row_hi < side)):
            self.rows[i, : side - self.row_lo[i]] = 0
            self.rows[i, side + gram + self.row_hi[i] :] = 0
        self.back = rank[back]
        self.least = np.full(len(order), _NULL_ID)
        np.minimum.at(self.least, self.back, self.doc)
        self.most = np.full(len(order), -_NULL_ID)
        np.maximum.at(self.most, self.back, self.doc)
        self.block, self.gram, self.row_at = block, gram, start

    def halves(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes (of ``bits`` bits, sorted) of the half contexts,
        whether each stands in two documents here, and the places of each
        context's right and left half among them (or their number: none)."""
        half = (self.side + 1) // 2
        value, doc_low, doc_high, where = [], [], [], []
        for salt, fits, begin, end in (
            (0, self.row_hi >= half, self.row_at, self.row_at + self.gram + half),
            (0x632BE59BD9B4E019, self.row_lo >= half, self.row_at - half, self.row_at + self.gram),
        ):
            at = np.flatnonzero(fits)
            h = K.mix(self.block.hashes(begin[at], end[at]) ^ np.uint64(salt)) >> np.uint64(64 - bits) if len(at) else np.zeros(0, np.uint64)
            value.append(h)
            doc_low.append(self.least[at])
            doc_high.append(self.most[at])
            where.append(at)
        found, back = np.unique(np.concatenate(value), return_inverse=True)
        low, high = np.full(len(found), _NULL_ID), np.full(len(found), -_NULL_ID)
        np.minimum.at(low, back, np.concatenate(doc_low))
        np.maximum.at(high, back, np.concatenate(doc_high))
        places = []
        for at, mine in zip(where, np.split(back, [len(value[0])]), strict=True):
            place = np.full(len(self.rows), len(found))
            place[at] = mine
            places.append(place)
        return found, low < high, places[0], places[1]

    def cuts(self, splitters: np.ndarray) -> np.ndarray:
        """Where each bucket's rows begin, and their end."""
        n = len(self.rows)
        if not len(splitters):
            return np.array([0, n])
        both = np.concatenate([self.lead, splitters])
        order = np.lexsort((np.concatenate([np.ones(n), np.zeros(len(splitters))]), both[:, 1], both[:, 0]))
        place = np.flatnonzero(order >= n) - np.arange(len(splitters))
        return np.concatenate([[0], place, [n]])


def sort_words(words: list[np.ndarray], group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort: the order of rows by their words, and their groups.

    Rows are sorted by one word; only those still tied go on to the next.
    ``group`` comes before the words.  Groups are numbers of equal rows.
    """
    n = len(words[0])
    if group is None:
        order = np.argsort(words[0])
        key = words[0][order]
        rest = words[1:]
    else:
        order = np.argsort(group, kind="stable")
        key = group[order]
        rest = words
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    for word in rest:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group_of = np.cumsum(new)[at]
        rows = order[at]
        inner = np.lexsort((word[rows], group_of))
        rows = rows[inner]
        order[at] = rows
        value = word[rows]
        split = np.ones(len(at), bool)
        split[1:] = (value[1:] != value[:-1]) | (group_of[1:] != group_of[:-1])
        new[at] |= split
    return order, np.cumsum(new) - 1


def _words(rows: np.ndarray) -> list[np.ndarray]:
    n, width = rows.shape
    full = np.zeros((n, -(-width // 8) * 8), np.uint8)
    full[:, :width] = rows
    return list(full.view(">u8").astype(np.uint64).T)


def _common(rows: np.ndarray) -> np.ndarray:
    """Equal leading bytes of each row and the one before it; 0 for the first."""
    if len(rows) < 2:
        return np.zeros(len(rows), np.int64)
    differ = rows[1:] != rows[:-1]
    first = np.argmax(differ, axis=1)
    first[~differ.any(axis=1)] = rows.shape[1]
    return np.concatenate([[0], first])


def _neighbours(common: np.ndarray, order: np.ndarray) -> np.ndarray:
    """By row, the longest agreement with a neighbour in sorted order."""
    best = common.copy()
    best[:-1] = np.maximum(best[:-1], common[1:])
    out = np.empty(len(order), np.int64)
    out[order] = best
    return out


def verdicts(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each context, bits b: the window that starts b bytes before the
    anchor stands in a document smaller than ``least``."""
    side = window - gram
    out = np.zeros(len(rows), np.uint64)
    keep = np.arange(len(rows))
    for final in (False, True):
        if len(keep) < 2:
            return out
        after = rows[keep, side:]
        order_r, _ = sort_words(_words(after))
        common_r = _common(after[order_r])
        anchor = np.empty(len(keep), np.int64)
        anchor[order_r] = np.cumsum(common_r < gram)
        before = np.ascontiguousarray(rows[keep, :side][:, ::-1])
        order_l, _ = sort_words(_words(before), anchor)
        common_l = _common(before[order_l])
        common_l[np.concatenate([[True], anchor[order_l][1:] != anchor[order_l][:-1]])] = -1
        if not final:
            # a window in common needs as many bytes after and before
            may = (_neighbours(common_r, order_r) >= gram) & (_neighbours(common_r, order_r) + np.maximum(_neighbours(common_l, order_l), 0) >= window)
            keep = keep[may]
    docs = least[keep]
    for b in range(side + 1):
        fits = np.flatnonzero((lo[keep] >= b) & (hi[keep] >= side - b))
        if len(fits) < 2:
            continue
        right = np.empty(len(keep), np.int64)
        right[order_r] = np.cumsum(common_r < window - b)
        left = np.empty(len(keep), np.int64)
        left[order_l] = np.cumsum(common_l < b)
        key = right[fits] * (len(keep) + 1) + left[fits]
        order = np.argsort(key)
        key = key[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        low = np.minimum.reduceat(docs[fits][order], begin)
        smallest = np.repeat(low, np.diff(np.append(begin, len(key))))
        hit = fits[order[smallest < docs[fits][order]]]
        out[keep[hit]] |= np.uint64(1 << b)
    return out


def _valid_bits(lo: np.ndarray, hi: np.ndarray, side: int) -> np.ndarray:
    out = np.zeros(len(lo), np.uint64)
    for b in range(side + 1):
        out[(lo >= b) & (hi >= side - b)] |= np.uint64(1 << b)
    return out


def _half_sets(window: int, gram: int, bits: int, parts: int):
    """Each chunk's hashes of half contexts, by their leading bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for chunk, ids, starts, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                found = Contexts(*_open(ids, starts, data), window, gram).halves(bits)[0]
                cuts = _parts(found, bits, parts)
                rows = []
                for part, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    if b > a:
                        # steps between sorted numbers, lowest bytes first
                        steps = np.diff(found[a:b], prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
                        rows.append((part, chunk, b - a, press.compress(steps.tobytes())))
                for i in range(0, len(rows), 64):
                    cols = list(zip(*rows[i : i + 64], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], ["part", "chunk", "n", "payload"])

    return run


def _parts(found: np.ndarray, bits: int, parts: int) -> list[int]:
    edges = np.array([(i << bits) // parts for i in range(1, parts)], np.uint64)
    return [0, *np.searchsorted(found, edges).tolist(), len(found)]


def _met_twice(t: pa.Table) -> pa.Table:
    """For each chunk, which of its hashes another chunk has too."""
    unpack, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
    sets = []
    for n, z in zip(t.column("n").to_pylist(), t.column("payload"), strict=True):
        steps = np.frombuffer(unpack.decompress(z.as_py()), np.uint8).reshape(8, n).T
        sets.append(np.cumsum(np.ascontiguousarray(steps).view("<u8").ravel().astype(np.uint64), dtype=np.uint64))
    every = np.sort(np.concatenate(sets))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    flags = []
    for x in sets:
        at = np.minimum(np.searchsorted(twice, x), max(len(twice) - 1, 0))
        flags.append(press.compress(np.packbits(twice[at] == x if len(twice) else np.zeros(len(x), bool)).tobytes()))
    return pa.table([t.column("chunk"), t.column("part"), pa.array(flags, pa.binary())], ["chunk", "part", "flags"])


def _kept(row: dict, marks: pa.Table, window: int, gram: int, bits: int, parts: int) -> tuple[Contexts, np.ndarray]:
    """A chunk's contexts, and the places of those that may matter."""
    unpack = zstandard.ZstdDecompressor()
    c = Contexts(*_open(row["ids"], row["starts"], row["data"]), window, gram)
    found, twice, right, left = c.halves(bits)
    cuts = _parts(found, bits, parts)
    for mark in marks.to_pylist():
        a, b = cuts[mark["part"]], cuts[mark["part"] + 1]
        twice[a:b] |= np.unpackbits(np.frombuffer(unpack.decompress(mark["flags"]), np.uint8), count=b - a).astype(bool)
    twice = np.append(twice, False)
    return c, np.flatnonzero(twice[right] | twice[left])


def _leads(window: int, gram: int, bits: int, parts: int):
    """Leading bytes of some contexts that may matter, spread over the chunk."""

    def run(chunks: pa.Table, marks: pa.Table) -> pa.Table:
        out: list[bytes] = []
        for row in chunks.to_pylist():
            c, keep = _kept(row, marks, window, gram, bits, parts)
            some = keep[np.linspace(0, len(keep) - 1, min(SAMPLE, len(keep))).astype(int)] if len(keep) else keep
            out += [x.tobytes() for x in c.lead[some].astype(">u8")]
        return pa.table({"lead": pa.array(out, pa.binary())})

    return run


def _requests(window: int, gram: int, bits: int, parts: int, shared):
    """Sends on the contexts that may matter."""

    def run(chunks: pa.Table, marks: pa.Table) -> pa.Table:
        press = zstandard.ZstdCompressor(level=3)
        out = []
        for row in chunks.to_pylist():
            c, keep = _kept(row, marks, window, gram, bits, parts)
            edges = np.searchsorted(keep, c.cuts(shared.value)).tolist()
            for bucket, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                if b > a:
                    k = keep[a:b]
                    out.append((bucket, row["chunk"], b - a, press.compress(b"".join([c.least[k].tobytes(), k.astype(np.uint32).tobytes(), c.row_lo[k].astype(np.uint8).tobytes(), c.row_hi[k].astype(np.uint8).tobytes(), c.rows[k].tobytes()]))))
        trim()
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], ["bucket", "chunk", "n", "payload"])

    return run


def _bucket(window: int, gram: int):
    side = window - gram
    width = 2 * side + gram

    def run(t: pa.Table) -> pa.Table:
        unpack, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        sizes = t.column("n").to_numpy()
        total = int(sizes.sum())
        least, lo, hi = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total, np.int64)
        place = np.empty(total, np.uint32)
        rows = np.empty((total, width), np.uint8)
        edges = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            raw = unpack.decompress(t.column("payload")[i].as_py())
            m = b - a
            least[a:b] = np.frombuffer(raw, np.int64, m)
            place[a:b] = np.frombuffer(raw, np.uint32, m, 8 * m)
            lo[a:b] = np.frombuffer(raw, np.uint8, m, 12 * m)
            hi[a:b] = np.frombuffer(raw, np.uint8, m, 13 * m)
            rows[a:b] = np.frombuffer(raw, np.uint8, m * width, 14 * m).reshape(m, width)
        with np.errstate(over="ignore"):
            h = (lo * 256 + hi).astype(np.uint64)
            for word in _words(rows):
                h = K.mix(h * np.uint64(3) + word)
        order = np.argsort(h)
        key = h[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if total else np.zeros(0, np.int64)
        low = np.minimum.reduceat(least[order], begin)
        which = np.empty(total, np.int64)
        which[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, total)))
        one = order[begin]
        del h, key, order
        found = verdicts(rows[one], lo[one], hi[one], low, window, gram)
        valid = _valid_bits(lo, hi, side)
        bits = np.where(least > low[which], valid, found[which] & valid)
        out = []
        bucket = t.column("bucket")[0].as_py()
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            at = np.flatnonzero(bits[a:b])
            if len(at):
                out.append((t.column("chunk")[i].as_py(), bucket, press.compress(place[a:b][at].tobytes() + bits[a:b][at].tobytes())))
        del rows, least, lo, hi, place
        trim()
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], ["chunk", "bucket", "payload"])

    return run


def _apply(window: int, gram: int, carry: bool):
    """Removes from each chunk; with ``carry``, gives texts and other columns."""
    side = window - gram

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        columns: list[list] = [[] for _ in range(5)]
        rest: list[pa.Table] = []
        texts: list[str] = []
        for row in chunks.to_pylist():
            ids, block = _open(row["ids"], row["starts"], row["data"])
            c = Contexts(ids, block, window, gram)
            block.forget()
            bits = np.zeros(len(c.rows), np.uint64)
            c.rows = c.rows[:0]
            for answer in answers.to_pylist():
                raw = unpack.decompress(answer["payload"])
                m = len(raw) // 12
                bits[np.frombuffer(raw, np.uint32, m)] = np.frombuffer(raw[4 * m :], np.uint64)
            each = bits[c.back]
            later = c.doc > c.least[c.back]
            each[later] = _valid_bits(c.lo[later], c.hi[later], side)
            n = len(block.data)
            edge = np.zeros(n + 1, np.int32)
            starts = np.zeros(n + 1, bool)
            for b in range(side + 1):
                starts[c.at[(each >> np.uint64(b)) & np.uint64(1) > 0] - b] = True
            at = np.flatnonzero(starts)
            edge[at] += 1
            np.add.at(edge, at + window, -1)
            gone = np.cumsum(edge, dtype=np.int32)[:n] > 0
            removed = block.per_text(gone)
            first = gone.copy()
            first[1:] &= ~gone[:-1]
            first[block.starts[:-1][block.starts[:-1] < n]] = gone[block.starts[:-1][block.starts[:-1] < n]]
            last = gone.copy()
            last[:-1] &= ~gone[1:]
            ends = block.starts[1:][np.diff(block.starts) > 0] - 1
            last[ends] = gone[ends]
            spans = block.per_text(first)
            span_a, span_b = np.flatnonzero(first), np.flatnonzero(last) + 1
            span_at = np.concatenate([[0], np.cumsum(spans)]).tolist()
            kept = block.data[~gone].tobytes()
            kept_at = np.concatenate([[0], np.cumsum(np.diff(block.starts) - removed)]).tolist()
            columns[0] += [None if i == _NULL_ID else i for i in ids.tolist()]
            columns[1] += np.diff(block.starts).tolist()
            columns[2] += removed.tolist()
            begins = block.starts.tolist()
            columns[3] += [[{"start": x - begins[i], "end": y - begins[i]} for x, y in zip(span_a[span_at[i] : span_at[i + 1]].tolist(), span_b[span_at[i] : span_at[i + 1]].tolist(), strict=True)] for i in range(block.n)]
            pieces = [kept[a:b] for a, b in zip(kept_at[:-1], kept_at[1:], strict=True)]
            columns[4] += [hashlib.sha256(x).hexdigest() for x in pieces]
            if carry:
                rest.append(pa.ipc.open_stream(unpack.decompress(row["rest"])).read_all())
                texts += [x.decode("utf-8", "ignore") for x in pieces]
        if carry:
            table = pa.concat_tables(rest)
            return table.append_column("t", pa.array(texts, pa.string())).append_column("n_removed", pa.array(columns[2], pa.int64()))
        return pa.table([pa.array(x, f.type) for x, f in zip(columns, _RESULT, strict=True)], schema=_RESULT)

    return run


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_sha256", pa.string())])


def _splitters(leads: DataFrame, buckets: int) -> np.ndarray:
    """Leading bytes that cut the sample into ``buckets`` equal parts; only
    they reach the driver."""
    if buckets < 2:
        return np.zeros((0, 2), np.uint64)
    place = numbered(leads, [F.col("lead")], "place")
    n = place.count()
    # where floor(place * buckets / n) goes up by one
    at = F.expr(f"place > 0 AND place * {buckets} div {max(n, 1)} > (place - 1) * {buckets} div {max(n, 1)}")
    chosen = sorted({bytes(r["lead"]) for r in place.where(at).select("lead").collect()})
    return np.frombuffer(b"".join(chosen), ">u8").reshape(-1, 2).astype(np.uint64)


def _answered(chunks: DataFrame, window: int, gram: int, bucket: int):
    """Verdicts for each chunk."""
    size = chunks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("chunks")).head()
    buckets = max(1, -(-size["bytes"] // bucket))
    # few of that many numbers agree by chance
    bits = min(64, max(24, size["bytes"].bit_length() + 8))
    texts = chunks.select("chunk", "ids", "starts", "data")
    halves = map_arrow(texts, _half_sets(window, gram, bits, buckets), "part long, chunk long, n long, payload binary")
    marks = cut(halves.groupBy("part").applyInArrow(_met_twice, "chunk long, part long, flags binary"))
    # splitters come from contexts that are sent, of some chunks
    some, some_marks = (x.where(F.pmod(F.xxhash64("chunk"), F.lit(SHARE)) == 0) if size["chunks"] > 2 * SHARE else x for x in (texts, marks))
    leads = some.groupBy("chunk").cogroup(some_marks.groupBy("chunk")).applyInArrow(_leads(window, gram, bits, buckets), "lead binary")
    shared = chunks.sparkSession.sparkContext.broadcast(_splitters(leads, buckets))  # 16 bytes for each bucket
    sent = texts.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(_requests(window, gram, bits, buckets, shared), "bucket long, chunk long, n long, payload binary")
    return sent.groupBy("bucket").applyInArrow(_bucket(window, gram), "chunk long, bucket long, payload binary")


def _check(window: int, gram: int) -> None:
    if gram & (gram - 1) or not 16 <= gram < window or window - gram > 63:
        raise ValueError("gram must be a power of two from 16 on, and window up to 63 longer")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans and kept_sha256 of each row.

    ``spans`` are the maximal removed byte ranges.  Null texts count as empty.
    Rows with one id are parts of one document, whose strings don't remove
    each other, and so are rows with a null id, which counts as the largest.
    Other columns are left out.
    Contexts of anchors are told apart by 64-bit hashes and compared byte by
    byte.  A single text of n bytes needs about 60 n bytes of memory.
    """
    require(docs, key, text)
    _check(window, gram)
    prepare(docs.sparkSession)
    chunks = cut(pack_chunks(docs, key, text, chunk))
    answers = _answered(chunks, window, gram, bucket)
    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept_sha256 string"
    return chunks.select("chunk", "ids", "starts", "data").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_apply(window, gram, False), schema)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", size: str = "n_chars", window: int = WINDOW, gram: int = GRAM, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text``.

    All columns and rows stay; a character that lost some of its bytes goes
    too.  ``size``, if there is such a column, is the new number of code
    points where bytes went.  A null text becomes empty.
    """
    require(docs, key, text)
    _check(window, gram)
    prepare(docs.sparkSession)
    chunks = cut(pack_chunks(docs, key, text, chunk, carry=True))
    answers = _answered(chunks, window, gram, bucket)
    others = [f for f in docs.schema if f.name != text]
    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(others)), "t string, n_removed long"])
    out = chunks.select("chunk", "ids", "starts", "data", "rest").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_apply(window, gram, True), schema)
    place = {f.name: f"c{i}" for i, f in enumerate(others)}
    columns = []
    for f in docs.schema:
        if f.name == text:
            column = F.col("t")
        elif f.name == size:
            column = F.when(F.col("n_removed") > 0, F.length("t").cast(f.dataType)).otherwise(F.col(place[f.name]))
        else:
            column = F.col(place[f.name])
        columns.append(column.alias(f.name))
    return out.select(*columns)
