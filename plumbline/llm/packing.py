"""Conflict-constrained best-fit packing of documents into bins of `capacity` words.

Documents go, largest first, into the bin with the least room that still takes them and holds neither their source nor
their duplicate cluster; if there is none, a new bin opens. Bins are ordered by their room. Each carries a bitmap with a
bit for each source and each duplicate cluster in it; a tree over the rooms 0 .. capacity keeps the bits that all bins
below a node have in common, so that the search for the next larger room passes over whole stretches of bins that
conflict in one bit and goes on until it finds the tightest bin that fits.

Rows are dealt by a hash of their values and of their number among rows alike to shards of about `shard_rows` documents,
each packed by itself: no task ever holds more, and a source with a third of all rows has a third of each shard. Texts
don't travel, only ids, sizes, sources and clusters.

Defined results: a document longer than `capacity` is cut; its full pieces fill bins of their own and the rest is packed;
a document without words (null or empty text) has one row with no bin; null is a source of its own, a null cluster
conflicts with nothing; repeated rows are packed each, and since they share their cluster, apart. Ties in size go by id,
then by their number; of equally tight bins the oldest is taken.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import distinct_documents, written
from plumbline.llm._workers import tidied

CAPACITY = 2048
SHARD_ROWS = 8192
#: Rows alike that one task numbers at a time.
REPEATS = 4096
#: Shuffle partitions at most; beyond, one holds several shards, sorted, and its task packs them one by one.
PARTITIONS = 1 << 12


class _Bins:
    """Bins by room. tree[node] has the bits common to all bins below the node; -1, all bits, if there are none."""

    def __init__(self, capacity: int) -> None:
        self.base = 1 << capacity.bit_length()
        self.tree = [-1] * (2 * self.base)
        self.leaves: list[dict[int, list[int]]] = [{} for _ in range(self.base)]  # room: bitmap: heap of bins

    def _update(self, room: int) -> None:
        node, tree = room + self.base, self.tree
        common = -1
        for bits in self.leaves[room]:
            common &= bits
        tree[node] = common
        node >>= 1
        while node:
            common = tree[2 * node] & tree[2 * node + 1]
            if tree[node] == common:
                return
            tree[node] = common
            node >>= 1

    def add(self, room: int, bits: int, number: int) -> None:
        heapq.heappush(self.leaves[room].setdefault(bits, []), number)
        self._update(room)

    def _below(self, node: int, wanted: int) -> int:
        """The least room below the node with a bin that has none of the wanted bits, or -1."""
        if self.tree[node] & wanted:
            return -1
        if node >= self.base:
            room = node - self.base
            return room if any(not bits & wanted for bits in self.leaves[room]) else -1
        found = self._below(2 * node, wanted)
        return found if found >= 0 else self._below(2 * node + 1, wanted)

    def take(self, size: int, wanted: int) -> tuple[int, int, int] | None:
        """Removes and returns (room, bits, number) of the tightest compatible bin."""
        node = size + self.base
        room = self._below(node, wanted)
        while room < 0 and node > 1:
            if not node & 1:
                room = self._below(node + 1, wanted)
            node >>= 1
        if room < 0:
            return None
        leaf = self.leaves[room]
        bits = min((b for b in leaf if not b & wanted), key=lambda b: leaf[b][0])
        number = heapq.heappop(leaf[bits])
        if not leaf[bits]:
            del leaf[bits]
        self._update(room)
        return room, bits, number


def pack_shard(items: list[tuple[int, int, int | None]], capacity: int) -> list[int]:
    """The bin of each item (size 1 .. capacity, source number, cluster number or None), items in packing order."""
    bins, out, opened = _Bins(capacity), [], 0
    places: dict[tuple[str, int], int] = {}
    for size, source, cluster in items:
        wanted = 1 << places.setdefault(("s", source), len(places))
        if cluster is not None:
            wanted |= 1 << places.setdefault(("c", cluster), len(places))
        found = bins.take(size, wanted)
        room, bits, number = found or (capacity, 0, opened)
        opened += found is None
        bins.add(room - size, bits | wanted, number)
        out.append(number)
    return out


SCHEMA = "doc_id long, piece long, start long, n_words long, source string, bin_id long"


def _numbered(items: DataFrame) -> DataFrame:
    """(doc_id, source, size, cluster, repeat): rows alike are counted, not gathered, and numbered from 0, some thousands of a kind in a task."""
    kinds = items.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"), F.col("cluster").cast("long"))
    counted = kinds.groupBy(*kinds.columns).agg(F.count(F.lit(1)).alias("n"))
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / REPEATS))))
    heads, rest = runs.filter("run = 0"), runs.filter("run > 0").repartition("doc_id", "run")
    numbers = F.sequence(F.col("run") * REPEATS, F.least(F.col("n"), (F.col("run") + 1) * REPEATS) - 1)
    return heads.unionByName(rest).select(*kinds.columns, F.explode(numbers).alias("repeat"))


def pack(items: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """SCHEMA for items (doc_id, source, size, cluster long): one row a piece. The result depends on the rows alone, not on files or partitions."""
    table = written(_numbered(items), "items")
    shards = max(1, math.ceil(table.count() / shard_rows))
    parts = min(shards, PARTITIONS)
    shard = F.pmod(F.xxhash64("doc_id", "source", "size", "cluster", "repeat"), F.lit(shards)).cast("int")
    dealt = table.withColumn("shard", shard).repartitionById(parts, F.pmod("shard", F.lit(parts)))
    dealt = dealt.sortWithinPartitions("shard") if parts < shards else dealt

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for *item, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and number != at:
                    yield from _packed(held, at, capacity)
                    held = []
                at = number
                held.append(tuple(item))
        if held:
            yield from _packed(held, at, capacity)

    return dealt.select("doc_id", "source", "size", "cluster", "repeat", "shard").mapInArrow(tidied(run), SCHEMA)


def _packed(items: list[tuple], shard: int, capacity: int) -> Iterator[pa.RecordBatch]:
    """Rows of one shard's items (doc_id, source, size, cluster, repeat)."""
    first = shard << 32  # bins of a shard are numbered from here
    items.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "", x[2], x[3] is None, x[3] or 0, x[4]))
    held = [x[3] for x in items if x[3] is not None]
    seen: set[int] = set()
    shared = {c for c in held if c in seen or seen.add(c)}  # a cluster of one needs no bit
    sources = {s: i for i, s in enumerate(dict.fromkeys(x[1] for x in items))}
    rests, out, full = [], [], 0
    for doc, source, size, cluster, repeat in items:
        whole, rest = divmod(size, capacity)
        for piece in range(whole):
            out.append((doc, piece, piece * capacity, capacity, source, first + full))
            full += 1
        if rest:
            rests.append((-rest, doc is None, doc or 0, repeat, whole, source, cluster if cluster in shared or whole else None))
        elif not whole:
            out.append((doc, 0, 0, 0, source, None))
    rests.sort(key=lambda x: x[:4])  # stable: other ties stay in the order above
    bins = pack_shard([(-x[0], sources[x[5]], x[6]) for x in rests], capacity)
    out += [(None if missing else doc, whole, whole * capacity, -size, source, first + full + b) for (size, missing, doc, _, whole, source, _), b in zip(rests, bins, strict=True)]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
    names = ["doc_id", "piece", "start", "n_words", "source", "bin_id"]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """SCHEMA for docs (doc_id, text, source): size in words; texts alike but for case are a duplicate cluster."""
    from plumbline.llm.mixing import n_words

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    items = docs.select("doc_id", "source", n_words(text).alias("size"), F.xxhash64(F.lower(text)).alias("cluster"))
    return pack(items, capacity, shard_rows)


def pack_apart(docs: DataFrame, k: int = 5, percent: int = 80, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """SCHEMA for docs (doc_id, text, source): size in words; documents linked by MinHash (A-Z lower-cased) are a duplicate cluster."""
    from plumbline.llm.minhash import near_duplicates

    base, unique = distinct_documents(docs, ("source",))
    one = base if unique else base.dropDuplicates(["uid"])
    found = near_duplicates(one.select("uid", "text"), k, percent).select("uid", F.col("words").alias("size"), F.col("root").alias("cluster"))
    rows = base.select("uid", "doc_id", F.col("_c0").alias("source"))
    return pack(rows.join(found, "uid").drop("uid"), capacity, shard_rows)
