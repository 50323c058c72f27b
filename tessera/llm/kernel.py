"""Vectorised work on the UTF-8 bytes of many texts at once.

A :class:`Block` holds the concatenated bytes of a few texts.  Words, lines
and n-grams are found and hashed with numpy over the whole block, so that no
Python code runs per word.  Hashes have 64 bits: a polynomial over a random
table, then a finalising mix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 20
#: Bytes whose sums are held at once for hashing.
SUM_BYTES = 2 << 20

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
_powers: dict[str, np.ndarray] = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
#: Letters a-z (after lower-casing), digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each at least."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, SUM_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=_U)
    return _powers["up"][:n], _powers["down"][:n]


class Block:
    """Texts ``i`` lie at ``data[starts[i]:starts[i + 1]]``."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, first: int = 0):
        self.data, self.starts, self.first = data, starts, first
        self.n = len(starts) - 1
        self._sums: np.ndarray | None = None

    def forget(self) -> None:
        """Frees what hashing remembers."""
        self._sums = None

    def lowered(self) -> Block:
        return Block(LOWER[self.data], self.starts, self.first)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a flag or number given for each byte, by text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.starts[1:]] - total[self.starts[:-1]]

    def text_of(self, at: np.ndarray) -> np.ndarray:
        """The text that holds each byte position."""
        return np.searchsorted(self.starts, at, side="right") - 1

    def runs(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of bytes in the class ``member`` (a table of 256
        flags) that don't cross texts: starts, ends, text numbers."""
        inside = member[self.data]
        n = len(inside)
        before = np.zeros(n + 1, bool)
        before[1:] = inside
        edge = np.zeros(n + 1, bool)
        edge[self.starts] = True
        begins = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return begins, ends, self.text_of(begins)

    def hashes(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte ranges."""
        n = len(self.data)
        if n > SUM_BYTES and len(begins) > 1 and np.all(begins[1:] >= begins[:-1]):
            return self._piecewise(begins, ends)
        up, down = power(n + 1)
        if self._sums is None:
            with np.errstate(over="ignore"):
                self._sums = np.zeros(n + 1, _U)
                terms = _TABLE[self.data]
                terms *= up[:n]
                np.cumsum(terms, out=self._sums[1:])
        with np.errstate(over="ignore"):
            return mix((self._sums[ends] - self._sums[begins]) * down[begins] + (ends - begins).astype(_U))

    def _piecewise(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of ranges in order of begin, by pieces of a long text."""
        out = np.empty(len(begins), _U)
        long = ends - begins > SUM_BYTES // 2
        for i in np.flatnonzero(long).tolist():
            out[i] = Block(self.data[begins[i] : ends[i]], np.zeros(1, np.int64))._whole()[0]
        short = np.flatnonzero(~long)
        begins, ends, i = begins[short], ends[short], 0
        while i < len(short):
            low = int(begins[i])
            j = int(np.searchsorted(begins, low + SUM_BYTES // 2))
            high = int(ends[i:j].max())
            out[short[i:j]] = Block(self.data[low:high], np.zeros(1, np.int64)).hashes(begins[i:j] - low, ends[i:j] - low)
            i = j
        return out

    def _whole(self) -> np.ndarray:
        """The hash of all bytes, part by part."""
        total, scale, n = _U(0), _U(1), len(self.data)
        with np.errstate(over="ignore"):
            for a in range(0, n, SUM_BYTES):
                part = _TABLE[self.data[a : a + SUM_BYTES]]
                up, _ = power(len(part) + 1)
                total = total + scale * (part * up[: len(part)]).sum(dtype=_U)
                scale = scale * up[len(part)]
            return mix(np.array([total + _U(n)], _U))


def grams(h: np.ndarray, of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of one text, and where they start."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        x = np.zeros(n, _U)
        for j in range(k):
            x = mix(x * _U(3) + h[j : j + n])
    at = np.flatnonzero(of[:n] == of[k - 1 :])
    return x[at], at


def salted(h: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Hashes that also depend on the text's number."""
    with np.errstate(over="ignore"):
        return mix(h + mix(of.astype(_U) + _U(0x51ED2701)))


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of a string column, in order; null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield Block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j
