"""Exact n-gram Jaccard self-join by universe partitions.

A text's set holds the hashes of its distinct word n-grams.  Sets are put in
size bands so narrow that a link stays in one band or joins two neighbours.
Two linked sets of a band differ in at most H tokens.  The universe of tokens
is cut, by hash, into m segments; by the pigeonhole principle linked sets
agree in some segments, or differ there by one token:

* a segment may be indexed as it is (any difference spoils it) or with all
  its one-deletions too (it takes two differences to spoil it);
* with q segments of the second kind, at least m + q - H of the segments
  match, so each set may leave out the e = m + q - H - 1 segments that cost
  most.  Cost is judged by content alone (the fewest tokens first, which the
  most sets share), so both sides leave out the same ones of those they share.

m, q and e are chosen for each band by a cost model (:func:`allocate`).  Sets
that share a key form candidate groups; groups are verified exactly, whole
if they are small.  Keys of few tokens chain unrelated sets into groups that
grow faster than the input.  So large groups are cut up first, by sketches
(:func:`_refined`) that lose no link.  What is still large are near copies:
each band of such a group is cut into blocks, and pairs of blocks of one band
and of neighbouring bands are verified, as no link skips a band.  Only a
spanning forest of the links leaves a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernel as K
from .common import cut, free_name, map_arrow, partitions, prepare, release, require, trim
from .components import components, least

NGRAM = 5
PERCENT = 80
#: Words of bits that say which sets are candidates; broadcast, fixed size.
BITMAP_WORDS = 1 << 18
#: Sets, and bytes of their compressed texts, in one block of a candidate group.
GROUP = 1024
GROUP_BYTES = 2 << 20
#: Sketches, and bytes of them, in one block of a large group.
SKETCHES = 1 << 14
SKETCH_BYTES = 4 << 20
#: Pairs that a task holds before it keeps a spanning forest of them.
PAIRS = 1 << 20
#: Compressed bytes that one task verifies, about.
TASK_BYTES = 8 << 20
#: Keys that are merged in a task before they are shuffled, and sets that it
#: remembers.
MERGE = 1 << 18
MET = 100_000


def bounds(percent: int) -> Iterator[tuple[int, int]]:
    """Least and largest size of each band; no link skips a band."""
    low = 1
    while True:
        high = max(low, 100 * low // percent)
        yield low, high
        low = high + 1


@lru_cache
def bands(percent: int) -> np.ndarray:
    """Least sizes of bands, up to sets of 2**40 tokens."""
    out = []
    for low, _ in bounds(percent):
        out.append(low)
        if low > 1 << 40:
            return np.array(out, np.int64)
    raise AssertionError


@lru_cache
def allocate(low: int, high: int, percent: int) -> tuple[int, int, int]:
    """Segments m, of them q with one-deletions, and e that may be left out.

    The cost of a choice is the number of keys of a set of middle size and a
    penalty for keys of so few tokens that unrelated sets may share them.  Keys
    of deletions, one for every token, count fourfold: they are what moves.
    """
    most = (100 - percent) * 2 * high // (100 + percent)  # H
    size = (low + high) / 2
    best = None
    for share in (0.0, 0.1, 0.2, 0.3, 0.4, 0.6):
        e = math.ceil(share * (most + 1))
        m = most + 1 + e
        cost = most + 1 + _shared(size / m, m, e)
        if best is None or cost < best[0]:
            best = cost, m, 0, e
    m = (most + 2) // 2
    cost = 4 * (m + size) + _shared(size / m - 1, m, 0)
    return (best if best[0] <= cost else (cost, m, m, 0))[1:]


def _shared(per: float, m: int, e: int) -> float:
    """Penalty for the keys of no, one and two tokens that are expected among
    m segments of ``per`` tokens on average, without the e smallest.  Any set
    has an empty segment's key, and many may have one or two tokens alone."""
    per = max(per, 0.0)
    some, cost = 0.0, 0.0
    left = float(e)
    for tokens, weight in ((0, 1000.0), (1, 100.0), (2, 4.0)):
        some = m * math.exp(-per) * per**tokens / math.factorial(tokens)
        some += 2 * math.sqrt(some) if tokens < 2 else 0.0
        kept = max(0.0, some - left)
        left = max(0.0, left - some)
        cost += weight * kept
    return cost


def shingles(block: K.Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes by text, sorted, and where each text's begin."""
    low = block.lowered()
    begins, ends, of = low.runs(K.NOT_SPACE)
    h = low.hashes(begins, ends)
    g, at = K.grams(h, of, n)
    text = of[at]
    words = np.bincount(of, minlength=block.n)
    for i in np.flatnonzero((words > 0) & (words < n)):
        a = int(np.searchsorted(of, i))
        whole = np.uint64(words[i])
        for x in h[a : a + words[i]]:
            with np.errstate(over="ignore"):
                whole = K.mix(np.array([whole * np.uint64(3) + x], np.uint64))[0]
        g, text = np.append(g, whole), np.append(text, i)
    order = np.lexsort((g, text))
    g, text = g[order], text[order]
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (text[1:] != text[:-1])
    g, text = g[first], text[first]
    return g, np.searchsorted(text, np.arange(block.n + 1))


def set_ids(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, as a signed number; 0 for the empty set."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(K.mix(g ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)])
        sizes = np.diff(at).astype(np.uint64)
        ids = K.mix(total[at[1:]] - total[at[:-1]] + sizes)
    return np.where(sizes > 0, ids, 0).astype(np.int64)


def keys_of(g: np.ndarray, percent: int) -> np.ndarray:
    """Index keys of one set: for its own band and the next."""
    starts = bands(percent)
    own = int(np.searchsorted(starts, len(g), side="right")) - 1
    out = []
    for band in (own, own + 1):
        low, high = int(starts[band]), int(starts[band + 1]) - 1
        m, q, e = allocate(low, high, percent)
        if (100 - percent) * 2 * high // (100 + percent) == 0:
            continue  # only equal sets, which are one class
        seed = np.uint64(band * 2 + 1)
        with np.errstate(over="ignore"):
            where = ((K.mix(g ^ seed) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            value = K.mix(g + seed * np.uint64(0x9E3779B97F4A7C15))
            total = np.zeros(m, np.uint64)
            np.add.at(total, where, value)
            tag = K.mix(np.arange(m, dtype=np.uint64) + (seed << np.uint64(32)))
            exact = K.mix(total + tag)
            if q:
                out += [exact, K.mix(total[where] - value + tag[where])]
            else:
                few = np.bincount(where, minlength=m)
                # the fewest tokens cost most; ties by content
                out.append(exact[np.lexsort((exact, few))[e:]])
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), _digest(text).alias("digest"), F.col(text).cast("string").alias("t"))


def _digest(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def sets(docs: DataFrame, n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest (of the text), n_shingles and set_id of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in K.blocks(batch.column(2)):
                g, at = shingles(block, n)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(block.first, block.n) for i in (0, 1)), pa.array(np.diff(at)), pa.array(set_ids(g, at))], ["doc_id", "digest", "n_shingles", "set_id"]
                )

    return map_arrow(_rows(docs, key, text), run, "doc_id long, digest long, n_shingles long, set_id long")


def merged(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (key, set_id) that link the same sets as the given ones.

    Each key stays with its first owner alone, in the order given, in which a
    set's keys lie together and compress.  Each other owner is linked to that
    one by a key of the two, once however many keys they share.
    """
    if not len(keys):
        return keys, owners
    order = np.argsort(keys, kind="stable")
    k, o = keys[order], owners[order]
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    head = np.repeat(o[begin], np.diff(np.append(begin, len(k))))
    pairs = np.unique(np.stack([head, o], 1)[head != o], axis=0)
    with np.errstate(over="ignore"):
        own = K.mix(K.mix(pairs[:, 0].astype(np.uint64)) + pairs[:, 1].astype(np.uint64) + np.uint64(0x2545F491))
    first = np.sort(order[begin])
    return np.concatenate([keys[first], own, own]), np.concatenate([owners[first], pairs[:, 0], pairs[:, 1]])


def _keys(docs: DataFrame, n: int, percent: int, key: str, text: str) -> DataFrame:
    """key, set_id; a set that was met in the same task isn't indexed again,
    and a key that many sets of a task share leaves it about once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        keys: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            k, o = merged(np.concatenate(keys), np.concatenate(owners))
            for i in range(0, len(k), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(k[i : i + (1 << 16)].view(np.int64)), pa.array(o[i : i + (1 << 16)])], ["key", "set_id"])

        for batch in batches:
            for block in K.blocks(batch.column(2)):
                g, at = shingles(block, n)
                ids = set_ids(g, at).tolist()
                if len(met) > MET:
                    met.clear()
                for i, x in enumerate(ids):
                    if at[i + 1] - at[i] > 1 and x not in met:
                        met.add(x)
                        keys.append(keys_of(g[at[i] : at[i + 1]], percent))
                        owners.append(np.full(len(keys[-1]), x, np.int64))
                        held += len(keys[-1])
                if held > MERGE:
                    yield from flush()
                    keys, owners, held = [], [], 0
        if keys:
            yield from flush()

    return map_arrow(_rows(docs, key, text), run, "key long, set_id long")


def _bitmap(ids: DataFrame) -> np.ndarray:
    """Bits set for all ids (their lowest bits, as ids are hashes); at most
    BITMAP_WORDS rows reach the driver."""
    slot = F.col("set_id").bitwiseAND(BITMAP_WORDS * 64 - 1)
    got = ids.select(slot.alias("slot")).selectExpr("slot div 64 as w", "shiftleft(1L, cast(slot & 63 as int)) as bit")
    got = got.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITMAP_WORDS, np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def _texts(docs: DataFrame, n: int, bitmap: np.ndarray, key: str, text: str) -> DataFrame:
    """set_id and compressed text of sets that the bitmap may hold.  The ids
    are worked out again rather than joined to the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # BITMAP_WORDS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for block in K.blocks(batch.column(0)):
                found = set_ids(*shingles(block, n))
                slots = found & (BITMAP_WORDS * 64 - 1)
                may = (shared.value[slots >> 6] >> (slots & 63)) & 1
                if len(met) > MET:
                    met.clear()
                at = block.starts.tolist()
                rows = [(x, press.compress(block.data[at[i] : at[i + 1]].tobytes())) for i, x in enumerate(found.tolist()) if may[i] and not (x in met or met.add(x))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([z for _, z in rows], pa.binary())], ["set_id", "z"])

    texts = docs.select(F.col(text).cast("string").alias("t")).where("t <> ''")
    return map_arrow(texts, run, "set_id long, z binary").dropDuplicates(["set_id"])


def links(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of linked sets: i < j within one list, or across two."""
    every = sets_a if sets_b is None else sets_a + sets_b
    sizes = np.array([len(s) for s in every], np.int64)
    owner = np.repeat(np.arange(len(every)), sizes)
    token = np.concatenate(every)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    number = np.cumsum(np.concatenate([[0], token[1:] != token[:-1]]))
    back = np.argsort(owner, kind="stable")  # tokens by owner
    at = np.searchsorted(owner[back], np.arange(len(every) + 1))
    # of sorted owners of a token, those up to i come first
    place = np.arange(len(token)) - begin[number]
    first = len(sets_a) if sets_b is not None else 0
    out_i, out_j = [], []
    for i in range(first, len(every)):
        mine = back[at[i] : at[i + 1]]
        count = place[mine]
        mine, count = mine[count > 0], count[count > 0]
        if not len(mine):
            continue
        starts = begin[number[mine]]
        ends = np.cumsum(count)
        others = owner[np.repeat(starts - (ends - count), count) + np.arange(ends[-1])]
        shared = np.bincount(others, minlength=len(sets_a))[: len(sets_a) if sets_b is not None else i]
        union = sizes[i] + sizes[: len(shared)] - shared
        hit = np.flatnonzero(100 * shared >= percent * union)
        hit = hit[shared[hit] > 0]
        out_i.append(hit)
        out_j.append(np.full(len(hit), i - first if sets_b is not None else i))
    empty = np.zeros(0, np.int64)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (empty, empty)


def sketch_words(band: int, percent: int) -> int:
    """Words in the sketches of a band: two bits or more for a token, and a
    power of two, so that a sketch can be folded to that of the band below."""
    return max(1, 1 << (2 * int(bands(percent)[band]) - 1).bit_length() >> 6)


def sketch(g: np.ndarray, words: int) -> np.ndarray:
    """The parity of the tokens in each of 64 * words slots.  A token that one
    set alone has flips one bit, so sketches never differ in more bits than
    their sets do in tokens."""
    slots = (K.mix(g ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(64 * words - 1)).astype(np.int64)
    odd = (np.bincount(slots, minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Rows of sketches as they are with fewer words."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def near_pairs(x: np.ndarray, size_x: np.ndarray, y: np.ndarray | None, size_y: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs (i, j) whose sketches differ in no more
    bits than linked sets do in tokens: i < j within one list, or across two,
    where j counts on from those of x."""
    every = x if y is None else np.concatenate([x, y])
    sizes = size_x if y is None else np.concatenate([size_x, size_y])
    columns = np.ascontiguousarray(every.T)
    begin, half = 0 if y is None else len(x), (len(columns) + 1) // 2
    a, b, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for i in range(len(x)):
        start = max(begin, i + 1)
        most = (100 - percent) * (sizes[i] + sizes[start:]) // (100 + percent)
        bits = np.zeros(len(every) - start, np.int32)
        for c in columns[:half]:
            bits += np.bitwise_count(c[start:] ^ c[i])
        hit = np.flatnonzero(bits <= most)
        bits = bits[hit]
        for c in columns[half:]:
            bits += np.bitwise_count(c[start + hit] ^ c[i])
        hit = start + hit[bits <= most[hit]]
        a.append(np.full(len(hit), i))
        b.append(hit)
        held += len(hit)
        if held > PAIRS:
            nodes, to = least(np.concatenate(a), np.concatenate(b))
            a, b, held = [to], [nodes], 0
    nodes, to = least(np.concatenate(a), np.concatenate(b))
    apart = nodes != to
    return to[apart], nodes[apart]


def _forest(n: int, pairs: Iterator[tuple[int, int]]) -> list[int]:
    """The least number of each of n nodes' component."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in pairs:
        i, j = find(i), find(j)
        if i != j:
            root[max(i, j)] = min(i, j)
    return [find(i) for i in range(n)]


def _sets_of(z: list[bytes], n: int) -> list[np.ndarray]:
    unpack = zstandard.ZstdDecompressor()
    texts = pa.array([unpack.decompress(x) for x in z], pa.binary()).cast(pa.string())
    out = []
    for block in K.blocks(texts):
        g, at = shingles(block, n)
        out += [g[at[i] : at[i + 1]] for i in range(block.n)]
    return out


def _verifier(n: int, percent: int):
    """A task's rows: job, kind (0: a whole group, 1: one block, 2: two), side
    (of two blocks), set_id, copies, z.  Gives a member, the least of those it
    reaches here, its links here, and whether that is of a whole group."""

    def verify(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("job").to_pylist(), t.column("side").to_pylist(), t.column("set_id").to_pylist(), t.column("copies").to_pylist(), range(len(t)), strict=True))
        z = t.column("z")
        kinds = t.column("kind").to_pylist()
        a, b, degree, final = [], [], [], []
        i = 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j][0] == rows[i][0]:
                j += 1
            kind = kinds[rows[i][4]]
            left = [r for r in rows[i:j] if r[1] == 0]
            right = [r for r in rows[i:j] if r[1] == 1]
            i = j
            if len(left) < 2 if kind < 2 else not left or not right:
                continue
            found = [_sets_of([z[r[4]].as_py() for r in part], n) for part in (left, right)]
            x, y = links(found[0], found[1] if kind == 2 else None, percent)
            y = y + len(left) if kind == 2 else y
            members = left + right
            copies = np.array([r[3] for r in members], np.int64)
            near = np.bincount(x, weights=copies[y], minlength=len(members)) + np.bincount(y, weights=copies[x], minlength=len(members))
            root = _forest(len(members), zip(x.tolist(), y.tolist(), strict=True))
            linked = np.flatnonzero(near > 0).tolist()
            a += [members[k][2] for k in linked]
            b += [members[root[k]][2] for k in linked]
            degree += near[linked].astype(np.int64).tolist()
            final += [kind == 0] * len(linked)
        trim()
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(degree, pa.int64()), pa.array(final, pa.bool_())], ["a", "b", "links", "whole"])

    return verify


def _joined(docs: DataFrame, n: int, percent: int, key: str, text: str) -> DataFrame:
    """doc_id, digest, n_shingles, component (a set_id; null: no set),
    component_id and n_links of every row."""
    require(docs, key, text)
    spark = prepare(docs.sparkSession)
    members = cut(sets(docs, n, key, text))
    classes = members.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("size"))
    classes = cut(classes)
    w = Window.partitionBy("key")
    release(spark)
    shared = _keys(docs, n, percent, key, text).select("key", "set_id", F.min("set_id").over(w).alias("a"), F.max("set_id").over(w).alias("z")).where("a <> z")
    stars = cut(shared.where("set_id <> a").select(F.col("set_id").alias("b"), "a").distinct())
    groups = components(stars)  # node, label of candidate groups
    texts = cut(_texts(docs, n, _bitmap(groups.select(F.col("node").alias("set_id"))), key, text))
    jobs = cut(_jobs(groups, classes, texts, n, percent))
    moved = jobs.agg(F.sum("bytes").alias("n")).head()["n"] or 0
    task = F.pmod("job", F.lit(max(4 * partitions(docs), moved // TASK_BYTES)))
    rows = jobs.drop("bytes").join(classes.select("set_id", "copies"), "set_id").join(texts, "set_id")
    found = cut(rows.groupBy(task.alias("task")).applyInArrow(_verifier(n, percent), "a long, b long, links long, whole boolean"))
    # within whole groups the labels are final
    labels = found.where("whole").select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = labels.unionByName(components(found.where("NOT whole")))
    degrees = found.groupBy(F.col("a").alias("linked")).agg(F.sum("links").alias("links"))
    named = classes.join(labels, F.col("set_id") == F.col("node"), "left").join(degrees, F.col("set_id") == F.col("linked"), "left")
    named = cut(named.select("set_id", "least", "copies", F.coalesce("label", "set_id").alias("label"), F.coalesce("links", F.lit(0)).alias("links")))
    release(spark)
    least = named.groupBy("label").agg(F.min("least").alias("component_id")).withColumnRenamed("label", "of")
    named = named.join(least, F.col("label") == F.col("of")).select(F.col("set_id").alias("class"), "label", "component_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    return members.join(named, (F.col("set_id") == F.col("class")) & (F.col("n_shingles") > 0), "left").select(
        "doc_id", "digest", "n_shingles", F.col("label").alias("component"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


def _blocks(most: int, most_bytes: int) -> Column:
    return F.ceil(F.greatest(F.count(F.lit(1)) / most, F.sum("bytes") / most_bytes)).cast("int")


def _whole(rows: DataFrame) -> DataFrame:
    """``rows`` (label, bytes) with whether their group is one block."""
    whole = rows.groupBy("label").agg((_blocks(GROUP, GROUP_BYTES) == 1).alias("whole")).withColumnRenamed("label", "of")
    return rows.join(whole, F.col("label") == F.col("of")).drop("of")


def _paired(rows: DataFrame, blocks: Column) -> DataFrame:
    """``rows`` (set_id, label, band, bytes) of large groups with job, kind and
    side: a set meets the blocks of its own band and of the two next to it."""
    cuts = cut(rows.groupBy("label", "band").agg(blocks.alias("blocks")))
    columns = rows.columns
    for name, step in (("own", 0), ("above", 1), ("below", -1)):
        side = cuts.select(F.col("label").alias("of"), (F.col("band") - step).alias("of_band"), F.col("blocks").alias(name))
        rows = rows.join(side, (F.col("label") == F.col("of")) & (F.col("band") == F.col("of_band")), "left").drop("of", "of_band")
    rows = rows.withColumn("block", F.coalesce(F.pmod(F.xxhash64("set_id"), "own"), F.lit(0)).cast("int"))

    def each(name: str, made) -> Column:
        numbers = F.when(F.col(name) > 0, F.sequence(F.lit(0), F.col(name) - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda j: F.struct(*(x.alias(k) for k, x in zip(("job", "kind", "side"), made(j), strict=True))))

    block, band = F.col("block"), F.col("band")
    own = each("own", lambda j: (F.xxhash64("label", band, F.least(block, j), F.lit(0), F.greatest(block, j)), F.when(block == j, 1).otherwise(2), F.when(block <= j, 0).otherwise(1)))
    above = each("above", lambda j: (F.xxhash64("label", band, block, F.lit(1), j), F.lit(2), F.lit(0)))
    below = each("below", lambda j: (F.xxhash64("label", band - 1, j, F.lit(1), block), F.lit(2), F.lit(1)))
    return rows.select(*columns, F.explode(F.concat(own, above, below)).alias("pair")).select(*columns, "pair.job", "pair.kind", "pair.side")


def _sketches(texts: DataFrame, n: int, percent: int, bitmap: np.ndarray) -> DataFrame:
    """set_id, size and sketch of sets that the bitmap may hold."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)  # BITMAP_WORDS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            slots = ids & (BITMAP_WORDS * 64 - 1)
            may = np.flatnonzero((shared.value[slots >> 6] >> (slots & 63)) & 1)
            if len(may):
                found = _sets_of([batch.column(1)[i].as_py() for i in may.tolist()], n)
                own = np.searchsorted(bands(percent), [len(g) for g in found], side="right") - 1
                made = [sketch(g, sketch_words(b, percent)).tobytes() for g, b in zip(found, own.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[may]), pa.array([len(g) for g in found], pa.int64()), pa.array(made, pa.binary())], ["set_id", "size", "sketch"])

    return map_arrow(texts.select("set_id", "z"), run, "set_id long, size long, sketch binary")


def _nearer(percent: int):
    """A job's rows: kind (1: one block, 2: two), side (of two blocks), set_id,
    size, sketch.  Gives a spanning forest of the pairs that may link."""

    def run(t: pa.Table) -> pa.Table:
        side, ids, size = (t.column(c).to_numpy() for c in ("side", "set_id", "size"))
        sketches = t.column("sketch").to_pylist()
        parts = [np.flatnonzero(side == k) for k in (0, 1)]
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(parts[0]) and (len(parts[1]) or t.column("kind")[0].as_py() == 1):
            x, y = (np.frombuffer(b"".join(sketches[i] for i in part), np.uint64).reshape(len(part), -1) if len(part) else None for part in parts)
            words = x.shape[1] if y is None else min(x.shape[1], y.shape[1])
            a, b = near_pairs(folded(x, words), size[parts[0]], None if y is None else folded(y, words), size[parts[1]], percent)
            ids = ids[np.concatenate(parts)]
            a, b = ids[a], ids[b]
        trim()
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _refined(sets_of: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """``sets_of`` with large groups cut into those that sketches leave.

    All pairs of sketches of a band, and of neighbouring bands, of a large
    group are compared, so a link's two sets stay in one group; a set that no
    other comes near is dropped.  A sketch has a few hundredths of its text's
    bytes and blocks of them are larger, so what is moved stays near what it
    is for each set.
    """
    rows = cut(_whole(sets_of))
    large = rows.where("NOT whole").drop("whole")
    if large.isEmpty():
        return rows
    made = _sketches(texts, n, percent, _bitmap(large.select("set_id")))
    made = cut(large.select("set_id", "label", "band").join(made, "set_id").withColumn("bytes", F.length("sketch")))
    pairs = _paired(made.drop("size", "sketch"), _blocks(SKETCHES, SKETCH_BYTES)).select("set_id", "job", "kind", "side")
    pairs = pairs.join(made.select("set_id", "size", "sketch"), "set_id")
    stars = cut(pairs.groupBy("job").applyInArrow(_nearer(percent), "a long, b long"))
    parts = components(stars).select(F.col("node").alias("set_id"), F.col("label").alias("part"))
    parts = large.join(parts, "set_id").select("set_id", F.col("part").alias("label"), "bytes", "band")
    return cut(_whole(rows.where("whole").select("set_id", "label", "bytes", "band").unionByName(parts)))


def _jobs(groups: DataFrame, classes: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """set_id, bytes, job, kind and side: a row for each job that a set is in.

    A block is bounded in sets and in bytes.  A group of one block is one job.
    """
    starts = F.array(*(F.lit(int(x)) for x in bands(percent)))
    sets_of = groups.join(classes.select("set_id", "size"), F.col("node") == F.col("set_id")).drop("node")
    sets_of = sets_of.join(texts.select("set_id", F.length("z").alias("bytes")), "set_id")
    sets_of = sets_of.select("set_id", "label", "bytes", (F.size(F.filter(starts, lambda x: x <= F.col("size"))) - 1).alias("band"))
    rows = _refined(sets_of, texts, n, percent)
    alone = rows.where("whole").select("set_id", "bytes", F.xxhash64("label").alias("job"), F.lit(0).alias("kind"), F.lit(0).alias("side"))
    return alone.unionByName(_paired(rows.where("NOT whole").drop("whole"), _blocks(GROUP, GROUP_BYTES)).select("set_id", "bytes", "job", "kind", "side"))


def jaccard_join(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row.

    Two rows link when 100 * intersection >= percent * union of their sets of
    distinct word n-grams (a shorter text is one n-gram; an empty or null one
    has none and links with nothing).  component_id is the least doc_id that
    links reach, n_links the number of other rows it links with.  Rows with
    equal sets are one class, so copies aren't paired; repeated rows and rows
    that share an id count each.  Rows with a null key count as documents with
    a null id, which is no component's least unless all its ids are null.
    Other columns are left out.  N-grams and sets are told apart by 64-bit
    hashes.
    """
    return _joined(docs, n, percent, key, text).drop("digest", "component")


#: Removed documents whose ids are broadcast; more are joined by a shuffle.
MAX_BROADCAST_IDS = 500_000


def one_of_each(docs: DataFrame, n: int = NGRAM, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: one row of each component.

    It is the row with the least id (a null id is the largest), and of rows
    that share that id the one whose text has the least hash; of rows equal in
    both one stays.  Rows with one id in different components don't affect
    each other.  Rows without a set (null or empty text) all stay.
    """
    joined = _joined(docs, n, percent, key, text).where("component IS NOT NULL")
    rows = cut(joined.groupBy("component", "doc_id", "digest").agg(F.count(F.lit(1)).alias("copies")))
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first"))
    first = first.select(F.col("component").alias("of"), F.col("first.doc_id").alias("first_id"), F.col("first.digest").alias("first_digest"))
    marked = rows.join(first, F.col("component") == F.col("of")).withColumn("stays", F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("digest") == F.col("first_digest")))
    id_name, digest_name = free_name(docs, "removed_id"), free_name(docs, "removed_digest")
    marked = cut(marked.where("NOT stays OR copies > 1").select(F.col("doc_id").alias(id_name), F.col("digest").alias(digest_name), "stays"))

    def side(stays: bool) -> tuple[DataFrame, int]:
        part = marked.where("stays" if stays else "NOT stays").drop("stays")
        few = part.limit(MAX_BROADCAST_IDS + 1).count()
        return (F.broadcast(part) if few <= MAX_BROADCAST_IDS else part), few

    same = F.col(key).cast("long").eqNullSafe(F.col(id_name)) & (_digest(text) == F.col(digest_name))
    gone, n_gone = side(False)
    if n_gone:
        docs = docs.join(gone, same, "left_anti")
    repeated, n_repeated = side(True)
    if n_repeated:
        # of rows with one id and text, one stays, by a hash of the columns
        sortable = [c for c, t in docs.dtypes if not t.startswith(("map", "variant"))]
        whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        one = docs.join(repeated, same, "left_semi").groupBy(F.col(key).cast("long"), _digest(text)).agg(F.min_by(whole, F.xxhash64(*(F.col(f"`{c}`") for c in sortable))).alias("row"))
        docs = docs.join(repeated, same, "left_anti").unionByName(one.select("row.*"))
    return docs
