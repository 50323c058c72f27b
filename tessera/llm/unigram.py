"""Unigram encoding and decoding of text with a SentencePiece vocabulary.

The most probable segmentation is found by Viterbi over the pieces' log
scores; the pieces lie in a double-array trie.  A character that no piece
covers costs ``UNKNOWN_COST`` more than the worst piece and becomes byte
pieces.  A marker (written as the space byte inside the trie) stands for a
space, and one is put before each text.  A BPE model has no log scores but
merge ranks: its k-th piece gets the log of a Zipf share, -ln(k H).  As no piece has a marker after
another character, the text falls into units (spaces and the word after
them) that are segmented alone; equal units are segmented once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import map_arrow, require
from .pool import Pool, spread
from .pool import shared as pool_of

MARKER = "▁"
UNKNOWN_COST = 10.0
#: Units up to this many bytes are segmented together, longer ones alone.
LONG_UNIT = 64


class DoubleArray:
    """Trie as two arrays: the child of s by byte c is base[s] + c if check
    there is s; ``value`` has the piece that ends at a state, or -1."""

    def __init__(self, keys: list[bytes], values: list[int]):
        order = sorted(range(len(keys)), key=keys.__getitem__)
        size = 1 << 17
        self.base = np.zeros(size, np.int32)
        self.check = np.full(size, -1, np.int32)
        self.value = np.full(size, -1, np.int32)
        self.check[0] = 0
        used = np.zeros(size, bool)
        used[0] = True
        queue = [(0, 0, len(order), 0)]
        lowest, hint = 1, {}  # hint: where the search for so many children ended
        for state, lo, hi, depth in queue:  # the queue grows: breadth first
            children = []
            i = lo
            while i < hi:
                k = keys[order[i]]
                if len(k) == depth:
                    self.value[state] = values[order[i]]
                    i += 1
                    continue
                c, j = k[depth], i
                while j < hi and keys[order[j]][depth] == c:
                    j += 1
                children.append((c, i, j))
                i = j
            if not children:
                continue
            codes = np.array([c for c, _, _ in children])
            kind = min(len(codes), 32)
            base, used = self._place(used, max(lowest, hint.get(kind, 1)), codes)
            hint[kind] = base + int(codes[0]) - 256 * (kind == 1)
            while used[lowest]:
                lowest += 1
            self.base[state] = base
            for c, i, j in children:
                used[base + c] = True
                self.check[base + c] = state
                queue.append((base + c, i, j, depth + 1))
        # room for base + 255 anywhere
        self.base, self.check, self.value = (np.concatenate([x, np.full(256, fill, np.int32)]) for x, fill in ((self.base, 0), (self.check, -1), (self.value, -1)))

    def _place(self, used: np.ndarray, lowest: int, codes: np.ndarray) -> tuple[int, np.ndarray]:
        """The first base at which no child's place is taken."""
        at = lowest
        while True:
            while at + 8192 + 512 > len(used):
                grow = len(used)
                used = np.concatenate([used, np.zeros(grow, bool)])
                self.base, self.check, self.value = (np.concatenate([x, np.full(grow, fill, np.int32)]) for x, fill in ((self.base, 0), (self.check, -1), (self.value, -1)))
            for width in (64, 8192):
                base = np.flatnonzero(~used[at : at + width]) + at - codes[0]
                base = base[base > 0]
                free = ~used[base[:, None] + codes].any(1)
                if free.any():
                    return int(base[np.argmax(free)]), used
            at += 8192

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Next states, -1 where there is none."""
        to = self.base[states] + codes
        return np.where((self.check[to] == states) & (to > 0), to, -1)


class Unigram:
    """pieces: (text, log score, kind) by id; kind is 'normal', 'byte' or 'control'."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        normal = [(i, p, s) for i, (p, s, kind) in enumerate(pieces) if kind == "normal" and p]
        if any(MARKER in p.lstrip(MARKER) for _, p, _ in normal):
            raise ValueError("a piece has a marker after another character")
        self.raw = [p.replace(MARKER, " ").encode() if kind == "normal" else bytes([int(p[3:5], 16)]) if kind == "byte" else b"" for p, _, kind in pieces]
        self.digest = hash(tuple(pieces))
        self.score = np.array([s for _, s, _ in pieces], np.float64)
        self.byte_ids = np.zeros(256, np.int32)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == "byte":
                self.byte_ids[int(p[3:5], 16)] = i
        self.unknown = (min(s for _, _, s in normal) if normal else 0.0) - UNKNOWN_COST
        self.trie = DoubleArray([self.raw[i] for i, _, _ in normal], [i for i, _, _ in normal])
        self.longest = max((len(self.raw[i]) for i, _, _ in normal), default=1)
        self.size = np.array([len(r) for r in self.raw], np.int64)
        self.joined = np.frombuffer(b"".join(self.raw), np.uint8)
        self.at = np.cumsum(self.size) - self.size

    @classmethod
    def load(cls, path: str, ranks: bool | None = None) -> Unigram:
        """Pieces and scores of a SentencePiece model file.

        ``ranks`` says that the scores are merge ranks, not log scores; if it
        is None they are if they are all whole numbers.
        """
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = cls._pieces(m)
        if ranks is None:
            ranks = all(s == int(s) for _, s, kind in pieces if kind == "normal")
        return cls(zipf(pieces) if ranks else pieces)

    @staticmethod
    def _pieces(m) -> list[tuple[str, float, str]]:
        return [(m.id_to_piece(i), m.get_score(i), "byte" if m.is_byte(i) else "control" if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else "normal") for i in range(m.get_piece_size())]


    def segment(self, units: list[bytes]) -> list[np.ndarray]:
        """Ids of the best segmentation of each unit; of equally good ones,
        that whose last pieces are longest."""
        out: list = [None] * len(units)
        order = sorted((i for i, u in enumerate(units) if len(u) <= LONG_UNIT), key=lambda i: len(units[i]))
        for a in range(0, len(order), 8192):
            rows = order[a : a + 8192]
            for i, ids in zip(rows, self._together([units[i] for i in rows]), strict=True):
                out[i] = ids
        for i, u in enumerate(units):
            if out[i] is None:
                out[i] = self._alone(u)
        return out

    def flat(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self.segment(units)
        return np.concatenate(found), np.array([len(x) for x in found], np.int64)

    def _together(self, units: list[bytes]) -> list[np.ndarray]:
        n = len(units)
        lengths = np.array([len(u) for u in units])
        width = int(lengths.max(initial=0))
        data = np.frombuffer(b"".join(u.ljust(width + 4, b"\0") for u in units), np.uint8).reshape(n, width + 4).astype(np.int32)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, width + 1), np.int32)
        piece = np.full((n, width + 1), -1, np.int32)
        for i in range(width):
            rows = np.flatnonzero((best[:, i] > -np.inf) & (lengths > i))
            if not len(rows):
                continue
            lead = data[rows, i]
            chars = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            alone = np.zeros(len(rows), bool)
            live, state = np.arange(len(rows)), np.zeros(len(rows), np.int32)
            for j in range(i, min(width, i + self.longest)):
                state = self.trie.step(state, data[rows[live], j])
                ok = (state >= 0) & (lengths[rows[live]] > j)
                live, state = live[ok], state[ok]
                if not len(live):
                    break
                value = self.trie.value[state]
                has = value >= 0
                r, v = rows[live[has]], value[has]
                alone[live[has]] |= chars[live[has]] == j + 1 - i
                total = best[r, i] + self.score[v]
                better = total > best[r, j + 1]
                r = r[better]
                best[r, j + 1], back[r, j + 1], piece[r, j + 1] = total[better], i, v[better]
            r, to = rows[~alone], i + chars[~alone]
            total = best[r, i] + self.unknown
            better = total > best[r, to]
            r, to = r[better], to[better]
            best[r, to], back[r, to], piece[r, to] = total[better], i, -1
        out = []
        for u, m, b, p in zip(units, lengths.tolist(), back.tolist(), piece.tolist(), strict=True):
            out.append(self._ids(u, m, b, p))
        return out

    def _ids(self, u: bytes, end: int, back: list[int], piece: list[int]) -> np.ndarray:
        ids: list[int] = []
        while end > 0:
            start = back[end]
            if piece[end] >= 0:
                ids.append(piece[end])
            else:
                ids += self.byte_ids[list(u[start:end])].tolist()[::-1]
            end = start
        return np.array(ids[::-1], np.int32)

    def _alone(self, u: bytes) -> np.ndarray:
        n = len(u)
        best, back, piece = [-np.inf] * (n + 4), [0] * (n + 4), [-1] * (n + 4)
        best[0] = 0.0
        base, check, value, score = self.trie.base, self.trie.check, self.trie.value, self.score
        for i in range(n):
            here = best[i]
            if here == -np.inf:
                continue
            c = u[i]
            char = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
            alone, state = False, 0
            for j in range(i, n):
                to = int(base[state]) + u[j]
                if check[to] != state or not to:
                    break
                state = to
                v = int(value[state])
                if v >= 0:
                    alone |= j + 1 - i == char
                    if here + score[v] > best[j + 1]:
                        best[j + 1], back[j + 1], piece[j + 1] = here + score[v], i, v
            if not alone and here + self.unknown > best[i + char]:
                best[i + char], back[i + char], piece[i + char] = here + self.unknown, i, -1
        return self._ids(u, n, back, piece)

    def decode_block(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Bytes of each text; the space put before it is taken off."""
        ids = ids.astype(np.int64)
        lengths = self.size[ids]
        raw = self.joined[spread(self.at[ids], lengths)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        return [raw[a + (raw[a : a + 1] == b" ") : b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def decode(self, ids: list[int]) -> str:
        known = np.array([i for i in ids if 0 <= i < len(self.raw)], np.int64)
        return self.decode_block(known, np.array([len(known)]))[0].decode("utf-8", "replace")

    def encode(self, text: str) -> list[int]:
        return encode_block(Pool(self.flat), next(K.blocks(pa.array([text]))))[0].tolist()


def zipf(pieces: list[tuple[str, float, str]]) -> list[tuple[str, float, str]]:
    """Pieces whose log scores follow from the order of their scores (equal
    ones in order of id): the k-th of n has probability 1 / (k H(n))."""
    order = sorted((i for i, p in enumerate(pieces) if p[2] == "normal"), key=lambda i: (-pieces[i][1], i))
    whole = float(np.sum(1 / np.arange(1, len(order) + 1)))
    out = list(pieces)
    for k, i in enumerate(order, 1):
        out[i] = pieces[i][0], -float(np.log(k * whole)), "normal"
    return out


def encode_block(pool: Pool, block: K.Block) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and how many each text has."""
    filled = np.flatnonzero(np.diff(block.starts) > 0)
    data = np.insert(block.data, block.starts[filled], 0x20)
    starts = block.starts + np.concatenate([[0], np.cumsum(np.diff(block.starts) > 0)])
    led = K.Block(data, starts)
    begin = np.zeros(len(data), bool)
    space = data == 0x20
    begin[1:] = space[1:] & ~space[:-1]
    begin[starts[:-1][filled]] = True
    begins = np.flatnonzero(begin)
    ends = np.append(begins[1:], len(data))[: len(begins)]
    ids, lengths = pool.lookup(led, begins, ends)
    return ids, np.bincount(led.text_of(begins), weights=lengths, minlength=block.n).astype(np.int64)


def encode(docs: DataFrame, model: Unigram, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every whole text; null and empty texts
    have no ids.  The model (one vocabulary) is broadcast."""
    require(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pool_of(("unigram", shared.value.digest), lambda: Pool(shared.value.flat))
        for batch in batches:
            for block in K.blocks(batch.column(1)):
                ids, counts = encode_block(pool, block)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return map_arrow(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: Unigram) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give an empty text, and null
    or unknown ids inside a list give nothing."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shared.value.decode([i for i in r or () if i is not None]) for r in rows], pa.string())], ["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: Unigram, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes every whole text: doc_id, n_ids, n_byte_ids,
    log_score, ids_crc32, decoded_sha256, exact (decoding gave the text).

    A null text counts as empty and has no ids; repeated rows are encoded
    each; other columns are left out.  Byte pieces count nothing in log_score.
    """
    import hashlib
    import zlib

    require(docs, key, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        pool = pool_of(("unigram", m.digest), lambda: Pool(m.flat))
        is_byte = np.zeros(len(m.raw), bool)
        is_byte[m.byte_ids] = True
        for batch in batches:
            for block in K.blocks(batch.column(1)):
                ids, counts = encode_block(pool, block)
                ends = np.concatenate([[0], np.cumsum(counts)])
                total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])  # noqa: B023, E731
                decoded = m.decode_block(ids, counts)
                raw, source = ids.astype("<u4"), block.data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, block.n),
                        pa.array(counts),
                        pa.array(total(is_byte[ids].astype(np.int64))),
                        pa.array(np.round(total(m.score[ids]), 3)),
                        pa.array([zlib.crc32(raw[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                        pa.array([x == source[a:b] for x, a, b in zip(decoded, block.starts[:-1].tolist(), block.starts[1:].tolist(), strict=True)]),
                    ],
                    ["doc_id", "n_ids", "n_byte_ids", "log_score", "ids_crc32", "decoded_sha256", "exact"],
                )

    return map_arrow(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")), run, "doc_id long, n_ids long, n_byte_ids long, log_score double, ids_crc32 long, decoded_sha256 string, exact boolean")
