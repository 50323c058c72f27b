"""URL filter: rules, and a ratio of character language models.

Two smoothed variable-order Markov models (orders 0 to ``ORDER``) are counted
over all accepted and all rejected URLs.  A URL's score is the difference of
its log-likelihoods, divided by its length; a threshold is calibrated on a
fifth of the labelled URLs that the models were not counted on.

Counts are exact and lie in DataFrames that grow with the distinct n-grams: a
byte and the ``ORDER`` bytes before it make one number, without hashing, whose
low bits are the n-grams of lower orders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .common import cut, map_arrow, prepare, require

ORDER = 5
#: Bits of one byte in an n-gram's number; 0 stands for the text's start.
BITS = 9
#: Rows that are scored together are 2 to this power at most.
CHUNK = 12
#: Weight of the next shorter context, in characters.
SMOOTHING = 2.0
#: Scores are calibrated on this many bins between -LIMIT and LIMIT.
BINS, LIMIT = 2000, 5.0

# Fixed values: (verdict, host, path) in the order given.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty if the URL is null or has no ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def with_rules(pages: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, host, path, rule (the longest that fits) and ruled."""
    require(pages, key, url)
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url")).withColumns({"host": host, "path": path})
    rule = verdict = None
    for decision, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, decision) if verdict is None else verdict.when(fits, decision)
    none = F.lit(None).cast("string")
    return rows.withColumns({"rule": none if rule is None else rule, "ruled": none if verdict is None else verdict})


def _grams(block: K.Block) -> tuple[np.ndarray, np.ndarray]:
    """The number of each byte's longest n-gram, and its text.

    Before its start a text has no context, so a context ends there.
    """
    n = len(block.data)
    of = np.repeat(np.arange(block.n), np.diff(block.starts))
    depth = np.arange(n) - block.starts[of]
    b = block.data.astype(np.int64) + 1
    gram = b.copy()
    for k in range(1, ORDER + 1):
        before = np.zeros(n, np.int64)
        before[k:] = b[: n - k]
        before[depth < k] = 0
        gram |= before << (BITS * k)
    return gram, of


def _target() -> Column:
    """What the models read: host and path."""
    return F.concat("host", "path")


def _fold() -> Column:
    return F.crc32(_target()) % 5 == 0


def _seen(rows: DataFrame) -> DataFrame:
    """The distinct n-grams of each chunk of ``rows`` (chunk, t, c): how often
    each stands in the counted URLs of either class, 0 in all others."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(chunk: int, parts: list[np.ndarray]) -> pa.RecordBatch:
            both, n = np.unique(np.concatenate(parts), return_counts=True)
            gram, first = np.unique(both >> 2, return_index=True)
            kind = both & 3
            n0, n1 = (np.add.reduceat(np.where(kind == c, n, 0), first) for c in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), chunk)), pa.array(gram), pa.array(n0), pa.array(n1)], ["chunk", "gram", "n0", "n1"])

        at, parts, size = None, [], 0
        for batch in batches:
            chunks, kind = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for block in K.blocks(batch.column(1), 1 << 20):
                gram, of = _grams(block)
                gram, chunk = gram << 2 | kind[block.first + of], chunks[block.first + of]
                for c in np.unique(chunk):
                    if parts and (c != at or size > 1 << 21):
                        yield table(at, parts)
                        parts, size = [], 0
                    at = c
                    parts.append(gram[chunk == c])
                    size += len(parts[-1])
        if parts:
            yield table(at, parts)

    return map_arrow(rows, count, "chunk long, gram long, n0 long, n1 long")


def _ratios(grams: DataFrame) -> DataFrame:
    """gram and ratio, the difference of its byte's log-likelihoods, of all
    ``grams`` (gram, n0, n1).

    Each order's n-grams are summed up from the longest.  A context has at most
    256 n-grams and an n-gram at most 257 longer ones, so no key is hot.
    """
    shorter = None
    for k in range(ORDER + 1):
        mask = (1 << (BITS * (k + 1))) - 1
        level = grams.groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        context = Window.partitionBy(F.shiftright("gram", BITS))
        level = level.withColumns({f"c{c}": F.sum(f"n{c}").over(context) for c in (0, 1)})
        if shorter is None:
            level = level.withColumns({"q0": F.lit(1 / 256), "q1": F.lit(1 / 256)})
        else:
            level = level.withColumn("short", F.col("gram").bitwiseAND(F.lit(mask >> BITS))).join(shorter, "short")
        shorter = level.select(F.col("gram").alias("short"), *(((F.col(f"n{c}") + SMOOTHING * F.col(f"q{c}")) / (F.col(f"c{c}") + SMOOTHING)).alias(f"q{c}") for c in (0, 1)))
    return shorter.select(F.col("short").alias("gram"), (F.log("q0") - F.log("q1")).alias("ratio"))


def fit(ruled: DataFrame) -> tuple[DataFrame, float] | None:
    """All rows with their scores, and the calibrated threshold; the models
    are counted on rows that a rule decided (all of them).  None if a class
    has no URLs to count.

    The driver gets the number of bytes of each class and 2 * (BINS + 1) bins.
    """
    prepare(ruled.sparkSession)
    names = ["page_id", "host", "path", "rule", "ruled"]
    rows = cut(ruled.select(*names).withColumn("chunk", F.shiftright(F.monotonically_increasing_id(), CHUNK)))
    label = F.when(F.col("ruled") == "block", 1).when(F.col("ruled").isNotNull(), 0).cast("long")
    seen = cut(_seen(rows.select("chunk", _target().alias("t"), F.when(label.isNull() | _fold(), F.lit(2)).otherwise(label).cast("long").alias("c"))))
    grams = cut(seen.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    total = grams.agg(F.sum("n0"), F.sum("n1")).first()
    if not total[0] or not total[1]:
        return None
    scored = cut(score(rows, seen.select("chunk", "gram").join(_ratios(grams), "gram")))
    fold = scored.where(label.isNotNull() & (F.length(_target()) > 0) & _fold()).select(label.alias("c"), F.floor((F.least(F.greatest("score", F.lit(-LIMIT)), F.lit(LIMIT)) + LIMIT) * (BINS / 2 / LIMIT)).cast("int").alias("bin"))
    bins = np.zeros((2, BINS + 1))
    for r in fold.groupBy("c", "bin").count().collect():  # 2 * (BINS + 1) rows at most
        bins[r["c"], r["bin"]] += r["count"]
    share = bins / np.maximum(bins.sum(1, keepdims=True), 1)
    # accepted at or over the threshold, rejected below it
    below = np.concatenate([[0], np.cumsum(share[1])]) + 1 - np.concatenate([[0], np.cumsum(share[0])])
    best = np.flatnonzero(below >= below.max() - 1e-12)
    threshold = (best[0] + best[-1]) / 2 / (BINS / 2 / LIMIT) - LIMIT if bins.any() else 0.0
    return scored, float(threshold)


def score(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows with their scores; ``known`` has the ratios of each chunk's
    n-grams."""
    names = ["page_id", "host", "path", "rule", "ruled"]

    def run(mine: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known.column("gram").to_numpy())
        grams, ratios = known.column("gram").to_numpy()[order], known.column("ratio").to_numpy()[order]
        parts = [np.zeros(0)]
        for block in K.blocks(mine.column("t"), 1 << 20):
            gram, of = _grams(block)
            each = ratios[np.searchsorted(grams, gram)] if len(gram) else np.zeros(0)
            parts.append(np.bincount(of, weights=each, minlength=block.n) / np.maximum(np.diff(block.starts), 1))
        return mine.select(names).append_column("score", pa.array(np.concatenate(parts)))

    schema = "page_id long, host string, path string, rule string, ruled string, score double"
    return rows.withColumn("t", _target()).groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(run, schema)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row.

    The longest fitting rule decides; else the models do: allow if the score
    reaches the threshold.  A null URL or one without ``://`` has an empty
    host and path, which score 0 and are judged like others.  Without labelled
    URLs of both classes every undecided URL is allowed, with score 0.
    Repeated rows are counted and judged each; other columns are left out.
    """
    ruled = with_rules(pages, rules, key, url)
    fitted = fit(ruled)
    if fitted is None:
        return ruled.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit("allow")).alias("verdict"), F.lit(0.0).alias("score"))
    scored, threshold = fitted
    verdict = F.coalesce("ruled", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
