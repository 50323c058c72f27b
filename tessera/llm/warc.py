"""Fixity audit of archive files with Merkle trees.

A page becomes a WARC record; records lie in files in the order of their ids.
In each copy of the archive, records are hashed, ranges of ``RANGE`` bytes
hash their records in order of offset, and each higher level hashes ``FAN_OUT``
ranges.  Two copies are compared from the roots down: only children of nodes
that differ are looked at.

Ranges are those of the first copy's manifest.  A record of the other copy
has the offset that the manifest gives for its id (and its place among records
with that id), so a record that changed its length doesn't move those after
it.  Records that the manifest doesn't have come after its file's end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, require

RECORDS_PER_FILE = 1000
RANGE = 1 << 16
FAN_OUT = 16
LEVELS = 3


def record(key: Column, url: Column, payload: Column) -> Column:
    """The text of one response record; nulls count as empty."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(key.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def manifest(records: DataFrame) -> DataFrame:
    """file, offset, record_id, length, digest from record_id, length, digest.

    Rows that are repeated exactly are one entry, with ``copies`` of it one
    after another, so that a record repeated very often makes no large file;
    a null id is in file -1.  Entries of one id are ordered by digest.
    """
    entries = records.groupBy("record_id", "length", "digest").agg(F.count(F.lit(1)).alias("copies"))
    entries = entries.withColumn("file", F.coalesce(F.floor(F.col("record_id") / RECORDS_PER_FILE), F.lit(-1)).cast("long"))
    w = Window.partitionBy("file").orderBy("record_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return entries.withColumn("offset", F.coalesce(F.sum(F.col("length") * F.col("copies")).over(w), F.lit(0)).cast("long"))


def leaves(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """file, at, side (0: ours), record_id and hash of all records of both."""
    place = Window.partitionBy("file", "record_id").orderBy("digest", "length")
    entry = F.concat_ws(":", F.col("copies").cast("string"), "digest").alias("hash")
    a, b = (m.select("file", "record_id", "offset", F.row_number().over(place).alias("place"), (F.col("length") * F.col("copies")).alias("bytes"), entry) for m in (ours, theirs))
    # the manifest: where records lie, not what is in them
    index = a.select(F.col("file").alias("of"), F.col("record_id").alias("of_id"), F.col("place").alias("of_place"), F.col("offset").alias("at"))
    found = b.join(index, (F.col("file") == F.col("of")) & F.col("record_id").eqNullSafe(F.col("of_id")) & (F.col("place") == F.col("of_place")), "left")
    ends = ours.groupBy(F.col("file").alias("of")).agg(F.max(F.col("offset") + F.col("length") * F.col("copies")).alias("end"))
    before = Window.partitionBy("file").orderBy("record_id", "place").rowsBetween(Window.unboundedPreceding, -1)
    extra = found.where("at IS NULL").drop("of").join(ends, F.col("file") == F.col("of"), "left").withColumn("at", F.coalesce("end", F.lit(0)) + F.coalesce(F.sum("bytes").over(before), F.lit(0)))
    sides = ((0, a.withColumnRenamed("offset", "at")), (1, found.where("at IS NOT NULL")), (1, extra))
    return reduce(DataFrame.unionByName, (x.select("file", F.col("at").cast("long"), F.lit(side).alias("side"), "record_id", "hash") for side, x in sides))


def tree(both: DataFrame, levels: int = LEVELS, range_bytes: int = RANGE, fan_out: int = FAN_OUT) -> list[DataFrame]:
    """file, node, ours, theirs (hashes) of each level, the lowest first.

    A node gathers the records of ``range_bytes`` or ``fan_out`` children, so
    its lists are bounded.  Each level is written once, from the one below.
    """

    def hashed(at: str, column: Column) -> Column:
        listed = F.array_sort(F.collect_list(F.when(column.isNotNull(), F.struct(F.col(at).alias("at"), column.alias("hash")))))
        return F.sha2(F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["at"].cast("string"), x["hash"])), "\n"), 256)

    node = F.expr(f"at div {range_bytes}").alias("node")
    sides = (F.when(F.col("side") == side, F.col("hash")) for side in (0, 1))
    out = [cut(both.groupBy("file", node).agg(*(hashed("at", c).alias(n) for n, c in zip(("ours", "theirs"), sides, strict=True))))]
    for _ in range(levels):
        below = out[-1].withColumnRenamed("node", "child")
        parent = F.expr(f"child div {fan_out}").alias("node")
        out.append(cut(below.groupBy("file", parent).agg(*(hashed("child", F.col(n)).alias(n) for n in ("ours", "theirs")))))
    return out


def audit(ours: DataFrame, theirs: DataFrame, levels: int = LEVELS, range_bytes: int = RANGE, fan_out: int = FAN_OUT) -> DataFrame:
    """Damaged places: file, record_id, offset, ours and theirs (copies and
    digest; null: missing).

    Both are manifests.  Equal copies and empty ones give no rows.  Of records
    with one id, those that both copies have aren't damaged, whatever happened
    to the others.
    """
    both = cut(leaves(ours, theirs))
    bad = None
    for level in reversed(tree(both, levels, range_bytes, fan_out)):
        if bad is not None:
            level = level.join(bad, (level["file"] == bad["bad_file"]) & (F.expr(f"node div {fan_out}") == bad["bad_node"]), "left_semi")
        bad = cut(level.where("ours <> theirs").select(F.col("file").alias("bad_file"), F.col("node").alias("bad_node")))
    under = both.join(bad, (F.col("file") == F.col("bad_file")) & (F.expr(f"at div {range_bytes}") == F.col("bad_node")), "left_semi")
    one = under.groupBy("file", "at").agg(F.first("record_id", ignorenulls=True).alias("record_id"), *(F.max(F.when(F.col("side") == side, F.col("hash"))).alias(name) for side, name in ((0, "ours"), (1, "theirs"))))
    found = cut(one.where(~F.col("ours").eqNullSafe(F.col("theirs"))))

    def lost(name: str, other: str) -> DataFrame:
        mine = found.where(F.col(name).isNotNull()).select("file", "at", "record_id", name)
        there = found.where(F.col(other).isNotNull()).select(F.col("record_id").alias("id"), F.col(other).alias("entry"))
        return mine.join(there, F.col("record_id").eqNullSafe(F.col("id")) & (F.col(name) == F.col("entry")), "left_anti")

    left, right = lost("ours", "theirs"), lost("theirs", "ours").select(F.col("file").alias("f"), F.col("at").alias("a"), F.col("record_id").alias("r"), "theirs")
    return left.join(right, (F.col("file") == F.col("f")) & (F.col("at") == F.col("a")), "full").select(
        F.coalesce("file", "f").alias("file"), F.coalesce("record_id", "r").alias("record_id"), F.coalesce("at", "a").alias("offset"), "ours", "theirs"
    )


def audit_pages(pages: DataFrame, replica: Column, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Audits a copy of the archive whose payloads are ``replica``.

    Per entry of the archive: page_id, file, offset, length, copies, digest
    and status (ok, or damaged).  ``replica`` is an expression over columns
    page_id, url and payload.  Nulls count as empty, payloads are hashed whole
    however long, exactly repeated rows are one entry with their number, and
    other columns are left out, so they can't clash.
    """
    require(pages, key, url, payload)
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(payload).cast("string").alias("payload"))
    ours, theirs = (record(F.col("page_id"), F.col("url"), p) for p in (F.col("payload"), replica))
    hashed = rows.select("page_id", F.octet_length(ours).cast("long").alias("length"), F.sha2(ours, 256).alias("digest"), F.octet_length(theirs).cast("long").alias("their_length"), F.sha2(theirs, 256).alias("their_digest"))
    hashed = cut(hashed)
    mine = cut(manifest(hashed.select(F.col("page_id").alias("record_id"), "length", "digest")))
    other = cut(manifest(hashed.select(F.col("page_id").alias("record_id"), F.col("their_length").alias("length"), F.col("their_digest").alias("digest"))))
    bad = audit(mine, other).where("ours IS NOT NULL").select(F.col("file").alias("bad_file"), F.col("offset").alias("bad_offset"))
    return mine.join(bad, (F.col("file") == F.col("bad_file")) & (F.col("offset") == F.col("bad_offset")), "left").select(
        F.col("record_id").alias("page_id"), "file", "offset", "length", "copies", "digest", F.when(F.col("bad_file").isNull(), "ok").otherwise("damaged").alias("status")
    )
