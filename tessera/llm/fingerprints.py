"""Document fingerprints by consistent weighted sampling.

A text's words, weighted by how often they occur, are sampled ``SAMPLES``
times.  Each word and sample has r and c from Gamma(2, 1) and a uniform b,
all from hashes; with t = floor(ln weight / r + b) the word's value is
c exp(-r (t + 1 - b)), and the sample is the word and t with the least value.
Two texts share a sample with the probability of their generalised Jaccard
similarity.  As the draws and t determine the value, a sample is identified by
it, and a fingerprint is the hashes of the least values.

A gamma draw is the sum of two exponential ones, and their ratio is uniform
and independent of the sum.  So with u1 to u4 uniform, r = -ln(u1 u2),
b = ln(u2) / ln(u1 u2) and c = -ln(u3 u4).  Then t = floor(ln(weight / u2) / r)
and the value is c u1 (u1 u2) ** t; for a word that occurs once t is 0, so it
takes one logarithm.

Everything is DataFrame expressions.  A text's words stay in the partition
that holds the text: only texts and fingerprints are shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, partitions, prepare, require
from .kernel import mix

SAMPLES = 64
#: Texts are dealt to so many times the session's shuffle partitions, as the
#: words of a partition's texts are counted in memory.
FINER = 6
#: Words end at these characters.
SEPARATORS = r"[\x20\x09-\x0D]+"


def least_values(texts: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """key, side, m0 ... (the samples' least values) from key, side, text; a
    text without words has no row.

    The input must be partitioned by key, so that nothing is shuffled here.
    """
    words = texts.select("key", "side", F.explode(F.split("text", SEPARATORS)).alias("word")).where(F.col("word") != "")
    terms = words.select("key", "side", F.xxhash64("word").alias("h")).groupBy("key", "side", "h").agg(F.count(F.lit(1)).alias("n"))

    def uniform(x: Column, low: int, bits: int) -> Column:
        return (F.shiftrightunsigned(x, low).bitwiseAND((1 << bits) - 1) + 0.5) * 2.0**-bits

    def value(k: int) -> Column:
        x = F.col(f"x{k}")
        u1, u2 = uniform(x, 44, 20), uniform(x, 28, 16)
        once = -F.log(uniform(x, 14, 14) * uniform(x, 0, 14)) * u1
        return F.when(F.col("n") == 1, once).otherwise(once * F.pow(u1 * u2, F.floor(-F.log(F.col("n") / u2) / F.log(u1 * u2))))

    # one round of hashing: the word's hash, changed by a constant of the sample
    constants = mix(np.arange(1, samples + 1, dtype=np.uint64)).view(np.int64).tolist()
    hashed = terms.select("key", "side", "n", *(F.xxhash64(F.col("h").bitwiseXOR(F.lit(x))).alias(f"x{k}") for k, x in enumerate(constants)))
    return hashed.groupBy("key", "side").agg(*(F.min(value(k)).alias(f"m{k}") for k in range(samples)))


def fingerprint(samples: int = SAMPLES) -> Column:
    """Four bytes for each sample of ``least_values``."""
    return F.unhex(F.concat(*(F.lpad(F.hex(F.xxhash64(f"m{k}").bitwiseAND(0xFFFFFFFF)), 8, "0") for k in range(samples))))


def no_words(samples: int = SAMPLES) -> Column:
    return F.unhex(F.lit("0" * (8 * samples)))


def likeness(a: str, b: str, samples: int = SAMPLES) -> Column:
    """Share of equal samples; texts without words are like each other only."""
    same = sum(((F.substring(a, 4 * k + 1, 4) == F.substring(b, 4 * k + 1, 4)).cast("int") for k in range(samples)), F.lit(0))
    return same / float(samples)


def following(docs: DataFrame) -> DataFrame:
    """key, next_key, previous_key, previous_size in descending order of key.

    From key (unique, not null) and n_chars; after the last comes the first.
    Keys are range-partitioned and only one boundary row for each partition
    is looked at together, so no task gets all keys.
    """
    n = partitions(docs)
    ranged = cut(docs.select("key", "n_chars").repartitionByRange(n, F.col("key").desc()).withColumn("part", F.spark_partition_id()))
    w = Window.partitionBy("part").orderBy(F.col("key").desc())
    linked = ranged.select("key", "part", F.lead("key").over(w).alias("after"), F.lag("key").over(w).alias("before"), F.lag("n_chars").over(w).alias("before_size"))
    # A row for each of the n partitions, whatever the input.
    edges = ranged.groupBy("part").agg(F.max("key").alias("first"), F.min("key").alias("last"), F.min_by("n_chars", "key").alias("last_size"))
    order = Window.partitionBy(F.lit(0)).orderBy("part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = edges.select(
        F.col("part").alias("edge_part"),
        F.coalesce(F.lead("first").over(order), F.first("first").over(whole)).alias("next_first"),
        F.coalesce(F.lag("last").over(order), F.last("last").over(whole)).alias("previous_last"),
        F.coalesce(F.lag("last_size").over(order), F.last("last_size").over(whole)).alias("previous_last_size"),
    )
    return linked.join(F.broadcast(edges), F.col("part") == F.col("edge_part")).select(
        "key",
        F.coalesce("after", "next_first").alias("next_key"),
        F.coalesce("before", "previous_last").alias("previous_key"),
        F.when(F.col("before").isNotNull(), F.col("before_size")).otherwise(F.col("previous_last_size")).alias("previous_size"),
    )


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """key and fingerprint of every whole text, by words and their counts.

    Null and empty texts, and those of separators alone, share one
    fingerprint.  Keys may be null or repeated: each row has its own text's
    fingerprint, which is worked out once for all copies of the text.  Other
    columns are left out.
    """
    require(docs, key, text)
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("key", F.unhex(F.sha2("text", 256)))
    texts = rows.groupBy("key").agg(F.first("text").alias("text")).repartition(FINER * partitions(docs), "key")
    prints = least_values(texts.select("key", F.lit(0).alias("side"), "text"), samples).select("key", fingerprint(samples).alias("fingerprint"))
    return rows.select("id", "key").join(prints, "key", "left").select(F.col("id").alias(key), F.lower(F.hex(F.coalesce("fingerprint", no_words(samples)))).alias("fingerprint"))


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited form, and likenesses.

    The edited text has its last half replaced by the start of the next text
    (descending key).  Null texts count as empty.  Rows with a null key are
    left out, as they have no place in the order; of rows with one key that
    with the least hash of its text counts, once.  A text's only next text, in
    a table of one row, is itself.  Other columns are left out.
    """
    require(docs, key, text)
    prepare(docs.sparkSession)
    n = FINER * partitions(docs)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).where(F.col("key").isNotNull())
    digest = F.xxhash64("text")
    sizes = rows.select("key", F.struct(digest.alias("digest"), F.length("text").cast("long").alias("n_chars")).alias("of")).groupBy("key").agg(F.min("of").alias("of"))
    links = following(cut(sizes.select("key", "of.n_chars")))
    placed = rows.repartition(n, "key").groupBy("key").agg(F.min_by("text", digest).alias("text"))
    placed = placed.join(links.hint("shuffle_hash"), "key").withColumn("n_chars", F.length("text").cast("long"))
    # the start of each text goes to the text before it, no more of it than is used
    starts = placed.select(F.col("previous_key").alias("key"), F.expr("substring(text, 1, cast(previous_size div 2 as int))").alias("start"))
    both = placed.join(starts, "key").select(
        "key", "previous_key", "n_chars", "text",
        F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 2 as int)), substring(start, 1, cast(n_chars div 2 as int)))").alias("edited"),
    )
    sides = both.select(
        "key", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("text")), F.struct(F.lit(1).alias("side"), F.col("edited").alias("text")))).alias("s")
    ).select("key", "s.side", "s.text")
    prints = least_values(sides, samples).groupBy("key").agg(
        F.max(F.when(F.col("side") == 0, fingerprint(samples))).alias("own"), F.max(F.when(F.col("side") == 1, fingerprint(samples))).alias("other")
    )
    none = no_words(samples)
    table = cut(
        both.select("key", "previous_key", "n_chars", F.unhex(F.sha2(F.col("edited"), 256)).alias("sha"))
        .join(prints, "key", "left")
        .select("key", "previous_key", "n_chars", "sha", F.coalesce("own", none).alias("own"), F.coalesce("other", none).alias("other"))
    )
    after = table.select(F.col("previous_key").alias("key"), F.col("own").alias("next"))
    return table.join(after, "key").select(
        F.col("key").alias(key), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"),
        F.lower(F.hex("own")).alias("fingerprint"), F.lower(F.hex("other")).alias("edited_fingerprint"),
        likeness("own", "other", samples).alias("near_edited"), likeness("own", "next", samples).alias("near_next"),
    )
