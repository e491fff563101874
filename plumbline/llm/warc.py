"""WARC fixity: Merkle trees over the records of an archive, compared between replicas.

An archive is a table of record slots in order: position (0, 1, 2 ...) and record bytes; FILE_RECORDS consecutive slots
are a WARC file. A leaf hashes one record. A node covers FANOUT consecutive nodes of the level below and hashes, for each,
the offset where it begins within the node, its length and its hash: a record that is changed, cut, lost or moved changes
its own branch and no other. Two replicas compare roots; where nodes differ, and only there, the audit goes down to their
children, level by level, until it stands before the damaged records.

All of it is DataFrame functions. A level is a table in the shared folder, a FANOUT-th of the one below.

Defined results: null urls and payloads count as empty; repeated pages are records of their own; an empty archive has no
root and no findings; slots in one replica only are `missing` (of the second) or `extra`. Offsets are those in the first
replica's WARC file. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from plumbline.llm._common import discard, with_positions, written

FANOUT = 16
FILE_RECORDS = 4096


def record(url: Column, payload: Column) -> Column:
    """A WARC/1.1 resource record as text; its id comes from its content, so that equal pages are equal records."""
    body, uri = F.coalesce(payload, F.lit("")), F.coalesce(url, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:md5:"), F.md5(F.concat(uri, F.lit("\n"), body).cast("binary")),
        F.lit(">\r\nWARC-Target-URI: "), uri, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def archive(pages: DataFrame) -> DataFrame:
    """(position, page_id, url, html) of pages in the order of id (null last), url and payload hash."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("sha", F.sha2("html", 256))
    return with_positions(base, [F.col("page_id").asc_nulls_last(), F.col("url").asc_nulls_first(), F.col("sha")]).drop("sha")


def leaves(records: DataFrame) -> DataFrame:
    """Level 0 of (position, record string): (idx, n_bytes, hash)."""
    return records.select(F.col("position").alias("idx"), F.octet_length("record").cast("long").alias("n_bytes"), F.sha2(F.concat(F.lit("\x00"), F.col("record")).cast("binary"), 256).alias("hash"))


def _parents(level: DataFrame) -> DataFrame:
    kids = F.sort_array(F.collect_list(F.struct("idx", "n_bytes", "hash")))  # FANOUT at most
    lengths = F.transform(F.col("kids"), lambda k: k["n_bytes"])
    before = lambda i: F.aggregate(F.slice(lengths, 1, i), F.lit(0).cast("long"), lambda a, x: a + x)
    told = F.transform(F.col("kids"), lambda k, i: F.concat_ws(":", k["idx"], before(i), k["n_bytes"], k["hash"]))
    grouped = level.groupBy(F.floor(F.col("idx") / FANOUT).alias("parent")).agg(kids.alias("kids"), F.sum("n_bytes").alias("n_bytes"))
    return grouped.select(F.col("parent").alias("idx"), "n_bytes", F.sha2(F.concat(F.lit("\x01"), F.array_join(told, "|")).cast("binary"), 256).alias("hash"))


def tree(records: DataFrame, height: int) -> list[DataFrame]:
    """The levels of the tree from the leaves to level `height`, each a table."""
    levels = [written(leaves(records), "leaves")]
    while len(levels) <= height:
        levels.append(written(_parents(levels[-1]), "nodes"))
    return levels


def height_of(slots: int) -> int:
    """Levels above the leaves until one node covers all slots."""
    height, covered = 0, 1
    while covered < slots:
        height, covered = height + 1, covered * FANOUT
    return height


def damaged(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """(position, status) of the slots that differ, by descending from the roots into branches that differ."""
    bad: DataFrame | None = None
    for level in range(len(ours) - 1, -1, -1):
        a, b = ours[level], theirs[level]
        if bad is not None:
            a, b = (x.withColumn("up", F.floor(F.col("idx") / FANOUT)).join(bad.select(F.col("idx").alias("up")), "up", "left_semi") for x in (a, b))
        a, b = a.select("idx", F.col("n_bytes").alias("n1"), F.col("hash").alias("h1")), b.select("idx", F.col("n_bytes").alias("n2"), F.col("hash").alias("h2"))
        both = a.join(b, "idx", "full")
        differ = both.filter(~(F.col("h1").eqNullSafe(F.col("h2")) & F.col("n1").eqNullSafe(F.col("n2"))))
        status = F.when(F.col("h2").isNull(), "missing").when(F.col("h1").isNull(), "extra").otherwise("corrupt")
        above, bad = bad, written(differ.select("idx", status.alias("status")), "differing")
        if above is not None:
            discard(above)
        if bad.limit(1).count() == 0:
            break
    return bad.select(F.col("idx").alias("position"), "status")


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """(position, status) of the slots of two replicas (position, record) that differ."""
    top = [x.agg(F.max("position")).first()[0] for x in (first, second)]
    height = height_of(1 + max([-1, *(x for x in top if x is not None)]))
    trees = tree(first, height), tree(second, height)
    found = damaged(*trees)
    discard(*trees[0], *trees[1])
    return found


def audited_pages(pages: DataFrame, decayed: Column | None = None, lost: Column | None = None) -> DataFrame:
    """(page_id, position, warc_file, record_offset, record_bytes, record_sha256, status) of every page.

    pages are archived and a second replica is made with the payload `decayed` and without the records where `lost`;
    every finding of `audit` is the record's status, other records are intact.
    """
    slots = archive(pages)
    slots = slots.withColumn("_decayed", decayed if decayed is not None else F.col("html")).withColumn("_lost", lost if lost is not None else F.lit(False))
    first = slots.select("position", record(F.col("url"), F.col("html")).alias("record"))
    second = slots.filter(~F.col("_lost")).select("position", record(F.col("url"), F.col("_decayed")).alias("record"))
    found = audit(first, second)
    text = record(F.col("url"), F.col("html"))
    rows = slots.select("page_id", "position", F.floor(F.col("position") / FILE_RECORDS).alias("warc_file"), F.octet_length(text).cast("long").alias("record_bytes"), F.sha2(text.cast("binary"), 256).alias("record_sha256"))
    before = Window.partitionBy("warc_file").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)  # FILE_RECORDS at most
    rows = rows.withColumn("record_offset", F.coalesce(F.sum("record_bytes").over(before), F.lit(0)).cast("long"))
    return rows.join(found, "position", "left").select("page_id", "position", "warc_file", "record_offset", "record_bytes", "record_sha256", F.coalesce("status", F.lit("intact")).alias("status"))
