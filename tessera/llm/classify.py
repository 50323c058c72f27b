"""Quality by nearest-neighbour voting in a latent-semantic space.

Every whole text is described by three groups of terms: hashed byte trigrams,
hashed 4-grams of character classes, and the shares of its words that repeat
(the word before, a 3-word window, a line).  The hashed counts are weighted by
idf, and all is projected on the leading singular directions of the labelled
rows (latent semantic analysis).  The labelled vectors, at most ``max_labelled`` of
each label, are broadcast; every document takes exact cosine products with
all of them, block by block, and its nearest neighbours vote with weights
that grow with similarity.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import map_arrow, prepare, require, trim
from .rules import count_block

TRIGRAMS = 3072
SHAPES = 1020
SHARES = 4
WIDTH = TRIGRAMS + SHAPES + SHARES
#: Weight of a share of 1 beside the two hashed groups, each of length 1.
SHARE_WEIGHT = 2.0
DIMENSIONS = 64
NEIGHBOURS = 25
#: Labelled rows of each label that are fitted on, at most.
MAX_LABELLED = 1024
#: Neighbours that are this near to the last one's similarity vote too.
TIE = 1e-6
ACCEPT = 0.7


#: Character classes: lower case, upper case, digit, space, newline, other ASCII by itself, beyond ASCII.
CLASS = np.arange(256, dtype=np.uint32)
CLASS[0x61:0x7B], CLASS[0x41:0x5B], CLASS[0x30:0x3A], CLASS[0x80:] = 1, 2, 3, 1


def features(block: K.Block) -> np.ndarray:
    """Terms of each text: counts of the hashed groups, then the shares."""
    out = np.zeros((block.n, WIDTH), np.float32)
    d = block.data.astype(np.uint32)
    _hashed(block, d, 3, TRIGRAMS, out[:, :TRIGRAMS])
    _hashed(block, CLASS[block.data], 4, SHAPES, out[:, TRIGRAMS : TRIGRAMS + SHAPES])
    counts = count_block(block)
    words = counts["n_words"] + 10  # so that a short text has no large share by chance
    begins, ends, of = block.runs(K.NOT_SPACE)
    h = block.hashes(begins, ends)
    again = np.flatnonzero((h[1:] == h[:-1]) & (of[1:] == of[:-1])) + 1
    lines = block.per_text(block.data == 0x0A) + 4
    symbols = counts["n_symbols"] / (counts["word_chars"] + 40)
    for i, share in enumerate((np.bincount(of[again], minlength=block.n) / words, counts["n_repeat_words"] / words, counts["n_dup_lines"] / lines, symbols)):
        out[:, TRIGRAMS + SHAPES + i] = share
    return out


def _hashed(block: K.Block, codes: np.ndarray, k: int, width: int, out: np.ndarray) -> None:
    n = len(codes) - k + 1
    if n <= 0:
        return
    h = np.zeros(n, np.uint32)
    for j in range(k):
        h = (h ^ codes[j : j + n]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    h = ((h >> np.uint32(8)).astype(np.uint64) * np.uint64(width) >> np.uint64(24)).astype(np.int32)
    for i in range(block.n):
        a, b = block.starts[i], block.starts[i + 1] - k + 1
        if b > a:
            out[i] = np.bincount(h[a:b], minlength=width)


class Model:
    """idf, projection, labelled vectors and their labels; plain arrays."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, dimensions: int, neighbours: int):
        """``counts`` is changed."""
        self.labels, self.neighbours = labels.astype(np.float32), neighbours
        seen = np.count_nonzero(counts, axis=0)
        self.idf = np.log((1 + len(counts)) / (1 + seen)).astype(np.float32) + 1
        for a in range(0, len(counts), 256):
            counts[a : a + 256] = self.weighted(counts[a : a + 256])
        x = counts
        values, left = np.linalg.eigh(x @ x.T)
        top = np.argsort(values)[::-1][:dimensions]
        top = top[values[top] > 1e-6]
        left = np.ascontiguousarray(left[:, top] / np.sqrt(values[top]))
        self.projection = (x.T @ left).astype(np.float32)
        self.vectors = unit(x @ self.projection)

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        x[:, :TRIGRAMS] = unit(x[:, :TRIGRAMS])
        x[:, TRIGRAMS:-SHARES] = unit(x[:, TRIGRAMS:-SHARES])
        x[:, -SHARES:] = counts[:, -SHARES:] * SHARE_WEIGHT
        return unit(x)

    def score(self, counts: np.ndarray) -> np.ndarray:
        cosine = unit(self.weighted(counts) @ self.projection) @ self.vectors.T
        k = min(self.neighbours, cosine.shape[1])
        last = np.partition(cosine, -k, axis=1)[:, [-k]]
        weight = np.where(cosine >= last - TIE, np.exp(20 * (cosine - 1)), 0)
        vote = weight @ self.labels + 1e-9 * self.labels.mean()
        return np.round(np.clip(vote / (weight.sum(1) + 1e-9), 0, 1).astype(np.float64), 5)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def held_out(key: Column) -> Column:
    """Whether a row's label must not be learnt from."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def _collect_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        press = zstandard.ZstdCompressor(level=1)  # most counts are 0
        rows = [press.compress(row.tobytes()) for b in K.blocks(batch.column(2)) for row in features(b)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["id", "label", "counts"])


def _fitter(dimensions: int, neighbours: int):
    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("id").to_numpy())
        counts = np.empty((len(t), WIDTH), np.float32)
        unpack = zstandard.ZstdDecompressor()
        for at, row in zip(np.argsort(order), t.column("counts"), strict=True):
            counts[at] = np.frombuffer(unpack.decompress(row.as_buffer()), np.float32)
        model = Model(counts, t.column("label").to_numpy()[order], dimensions, neighbours)
        out = pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})
        del counts
        trim()
        return out

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS) -> Model | None:
    """A model from labelled rows that aren't held out; None without any.

    Of each label (0 and 1) the ``max_labelled`` rows with the smallest hash
    of the id are used, so the one task that fits holds 2 * max_labelled
    vectors at most, whatever the input; only the model comes to the driver.
    Null ids or labels are passed over; of repeated labels the largest counts,
    and of repeated ids the least text.
    """
    require(docs, key, text)
    prepare(docs.sparkSession)
    known = (
        labels.select(F.col(key).cast("long").alias("id"), F.col(label).cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
        .groupBy("id").agg(F.max("label").alias("label"))
    )
    present = docs.select(F.col(key).cast("long").alias("id")).where("id IS NOT NULL").join(known, "id").distinct()
    order = F.xxhash64("id")
    chosen = None
    for value in (0, 1):
        part = present.where(F.col("label") == value).orderBy(order, "id").limit(max_labelled)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * max_labelled rows of two numbers.
    rows = chosen.collect()
    if not rows:
        return None
    small = docs.sparkSession.createDataFrame(rows, chosen.schema)
    texts = (
        docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
        .join(F.broadcast(small), "id").groupBy("id", "label").agg(F.min("t").alias("t"))
    )
    counted = map_arrow(texts.select("id", "label", "t"), _collect_features, "id long, label int, counts binary")
    fitted = counted.groupBy(F.lit(0).alias("all")).applyInArrow(_fitter(dimensions, neighbours), "model binary")
    return pickle.loads(fitted.head()["model"])


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score in [0, 1] for every row of ``docs``.

    A null text counts as empty; an empty text has no neighbours nearer than
    others, so all votes are equal.  Labelled rows as similar as the last
    neighbour (by TIE) vote too, so ties don't hang on an order.  Repeated
    rows are scored each, other columns are left out, and scores are rounded
    to five digits.  Without a model the score is 0.5.
    """
    require(docs, key, text)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    if model is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"))
    spark = docs.sparkSession
    # 4096 x 64 and 2 * max_labelled x 64 floats: the size doesn't depend on the input.
    shared = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.score(features(b)) for b in K.blocks(batch.column(1))]
            if parts:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts).astype(np.float64))], ["doc_id", "score"])

    return map_arrow(rows, scored, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, **options) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= accept)."""
    out = score(docs, fit(docs, labels, **options))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that score ``accept`` or more, all columns kept.

    Texts are scored where they lie: nothing is shuffled.  Without a model
    (no labelled rows) every row stays.
    """
    model = fit(docs, labels, key=key, text=text, **options)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as in score()
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [shared.value.score(features(b)) for b in K.blocks(batch.column(at))]
            if parts:
                yield batch.filter(pa.array(np.concatenate(parts) >= accept))

    return map_arrow(docs, run, docs.schema)
