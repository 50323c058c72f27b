"""Cached encoding of the units (words) of texts, gathered with numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import kernel as K

#: Units that one Python worker remembers, about 50 bytes each; beyond it
#: starts anew.
MAX_UNITS = 500_000


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each range, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class Pool:
    """Remembers the ids of each unit by the unit's hash.

    ``encode`` gets units that are new, and returns their ids in a row and
    how many each has.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.slot = np.zeros(0, np.int64)  # of each key
        self.ids = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of sorted keys, -1 where there is none."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.slot[at], -1)

    def _add(self, keys: np.ndarray, units: list[bytes]) -> np.ndarray:
        found, lengths = self.encode(units)
        n, m = len(self.keys), len(self.keys) + len(units)
        need = self.used + len(found)
        if need > len(self.ids):
            self.ids = np.resize(self.ids, 2 * need)
        if m > len(self.start):
            self.start, self.length = np.resize(self.start, 2 * m), np.resize(self.length, 2 * m)
        self.ids[self.used : need] = found
        self.start[n:m] = self.used + np.cumsum(lengths) - lengths
        self.length[n:m] = lengths
        self.used = need
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.slot = np.insert(self.slot, at, np.arange(n, m))
        return np.arange(n, m)

    def lookup(self, block: K.Block, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all units in order, and how many each unit has."""
        if not len(begins):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        distinct, first, back = np.unique(block.hashes(begins, ends), return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > MAX_UNITS:
            self.clear()
        at = self._find(distinct)
        if len(new := np.flatnonzero(at < 0)):
            raw = block.data.tobytes()
            at[new] = self._add(distinct[new], [raw[a:b] for a, b in zip(begins[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
        slot = at[back]
        lengths = self.length[slot]
        return self.ids[spread(self.start[slot], lengths)], lengths


_shared: dict[object, Pool] = {}


def shared(name: object, make: Callable[[], Pool]) -> Pool:
    """The pool that this worker process has under ``name``; one at a time."""
    if name not in _shared:
        _shared.clear()
        _shared[name] = make()
    return _shared[name]
