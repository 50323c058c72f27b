"""Host-level quality rules.

Counts are taken per text.  A text that breaks one of the base rules (too few
words, too many repeated ones) is rejected itself; one that breaks any rule
(also: many symbols, many repeated lines, words of odd length) is a failure of
its host (the ``host`` column, for instance the site or feed a text came from).
Failure rates are shrunk towards the rate of the whole corpus by a beta prior
whose two parameters come from the hosts themselves (method of moments).  A
host is rejected with all its texts if its shrunk rate is over ``max_rate``,
or improbable under the prior and not small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import cut, free_name, map_arrow, require

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Symbols for each 100 characters of words, and repeated lines of 100.
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
#: Mean length of words.
WORD_LENGTH = (3, 12)
MAX_RATE = 0.5
#: Standard deviations of the prior above its mean that are improbable, and
#: the rate up to which a host isn't rejected for that.
IMPROBABLE = 3.0
SMALL_RATE = 0.25


def count_block(block: K.Block) -> dict[str, np.ndarray]:
    n = block.n
    begins, ends, of = block.runs(K.NOT_SPACE)
    h = block.hashes(begins, ends)
    heads = (block.data & 0xC0) != 0x80
    out = {
        "n_words": np.bincount(of, minlength=n),
        "word_chars": block.per_text(heads & K.NOT_SPACE[block.data]),
        "n_symbols": block.per_text(SYMBOLS[block.data]),
    }
    newline = np.zeros(256, bool)
    newline[0x0A] = True
    lb, le, lof = block.runs(~newline)
    has_word = np.searchsorted(begins, le) > np.searchsorted(begins, lb)
    lb, le, lof = lb[has_word], le[has_word], lof[has_word]
    key = np.sort(K.salted(block.hashes(lb, le), lof))
    distinct = np.zeros(n, np.int64)
    if len(lb):
        order = np.argsort(K.salted(block.hashes(lb, le), lof))
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        distinct = np.bincount(lof[order][first], minlength=n)
    out["n_lines"] = np.bincount(lof, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - distinct
    covered = np.zeros(len(h), bool)
    g, at = K.grams(h, of, 3)
    if len(g):
        key = K.salted(g, of[at])
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        twice = np.zeros(len(key), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = at[order[twice]]
        for j in range(3):
            covered[hit + j] = True
    out["n_repeat_words"] = np.bincount(of[covered], minlength=n)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [count_block(b) for b in K.blocks(batch.column(2))]
        if parts:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64)) for c in COUNTS)], ["doc_id", "host", *COUNTS])


def text_counts(docs: DataFrame, host: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, host and the counts of each whole text.

    A null or empty text has zero counts.  Repeated rows are counted each.
    """
    require(docs, key, host, text)
    schema = "doc_id long, host string, " + ", ".join(f"{c} long" for c in COUNTS)
    return map_arrow(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).cast("string").alias("text")), _counted, schema)


def base_rules(min_words: int, max_repeat_percent: int) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def other_rules() -> Column:
    low, high = WORD_LENGTH
    return (
        (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars"))
        | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"))
        | (F.col("word_chars") < low * F.col("n_words"))
        | (F.col("word_chars") > high * F.col("n_words"))
    )


def _rates(counts: DataFrame, max_rate: float) -> DataFrame:
    """rated_host, host_rate and rejected from host and failed."""
    hosts = counts.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("bad"))
    mean = F.col("total_bad") / F.col("total")
    prior = (
        hosts.agg(F.sum("n").alias("total"), F.sum("bad").alias("total_bad"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("square"))
        .withColumn("mean", mean)
        .withColumn("spread", F.greatest(F.col("square") / F.col("total") - F.col("mean") * F.col("mean"), F.lit(1e-6)))
        .withColumn("weight", F.greatest(F.lit(1.0), F.col("mean") * (1 - F.col("mean")) / F.col("spread") - 1))
        .withColumn("high", F.col("mean") + IMPROBABLE * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1)))
        .select((F.col("mean") * F.col("weight")).alias("alpha"), "weight", "high")
    )
    rate = F.col("host_rate")
    # The prior is one row, whatever the input.
    return (
        hosts.crossJoin(F.broadcast(prior))
        .withColumn("host_rate", F.round((F.col("bad") + F.col("alpha")) / (F.col("n") + F.col("weight")), 9))
        .select(F.col("host").alias("rated_host"), "host_rate", ((rate > max_rate) | ((rate > F.col("high")) & (rate > SMALL_RATE))).alias("rejected"))
    )


def host_rules(
    docs: DataFrame,
    host: str = "source",
    key: str = "doc_id",
    text: str = "text",
    min_words: int = MIN_WORDS,
    max_repeat_percent: int = MAX_REPEAT_PERCENT,
    max_rate: float = MAX_RATE,
) -> DataFrame:
    """doc_id, host, the counts, base_failed, failed (any rule), host_rate,
    rejected (the host) and kept, per row.

    Rows with a null host make up one host of their own.  An empty table
    gives an empty result; other columns of ``docs`` are left out, so they
    can't clash; a null text has no words; repeated rows count each.  Hosts
    are aggregated with partial sums and the join is on the host alone, so
    Spark's skew handling splits a hot one; the rows that move hold counts,
    not texts.
    """
    counts = text_counts(docs, host, key, text).withColumn("base_failed", base_rules(min_words, max_repeat_percent))
    counts = cut(counts.withColumn("failed", F.col("base_failed") | other_rules()))
    rates = _rates(counts, max_rate)
    return (
        counts.join(rates, F.col("host").eqNullSafe(F.col("rated_host")), "left")
        .drop("rated_host")
        .withColumn("kept", ~F.col("base_failed") & ~F.col("rejected"))
    )


#: Rejected hosts that are broadcast; more are joined by a shuffle.
MAX_BROADCAST_HOSTS = 100_000


def passing(docs: DataFrame, host: str = "source", key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT, max_rate: float = MAX_RATE) -> DataFrame:
    """The rows of ``docs`` that :func:`host_rules` keeps, all columns kept.

    Texts are filtered where they lie; only rejected hosts are joined.
    """
    require(docs, host, key, text)
    verdicts = host_rules(docs, host, key, text, min_words, max_repeat_percent, max_rate)
    name = free_name(docs, "rejected")
    rejected = cut(verdicts.where("rejected").select(F.col("host").alias(name)).distinct())
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for block in K.blocks(batch.column(at)):
                c = count_block(block)
                keep.append((c["n_words"] >= min_words) & (100 * c["n_repeat_words"] <= max_repeat_percent * c["n_words"]))
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    kept = map_arrow(docs, run, docs.schema)
    few = rejected.limit(MAX_BROADCAST_HOSTS + 1).count()
    if not few:
        return kept
    side = F.broadcast(rejected) if few <= MAX_BROADCAST_HOSTS else rejected
    return kept.join(side, F.col(host).cast("string").eqNullSafe(F.col(name)), "left_anti")
