"""What the two substring operators share: blobs for the exchange, spans of repeats, cutting them out of whole texts."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._workers import tidied

#: A minimiser with at least this share of all runs is heavy: windows choose it only if they hold no other.
HEAVY_SHARE = 2.0**-18
#: Raw bytes of texts that a task turns into one set of sorted, packed runs at a time.
FLUSH_BYTES = 20 << 20
#: Bytes of text that the numpy kernels work on at a time; a longer text is cut into overlapping pieces. A byte takes some 60 bytes of arrays.
CHUNK_BYTES = 1 << 18
#: Bytes of blobs that go to the JVM at a time.
BATCH_BYTES = 2 << 20
#: Raw bytes of packed runs that one bucket should hold.
BUCKET_BYTES = 20 << 20
#: A key of the packed 64-bit minimisers: the upper bits rank, the lower ones say where.
PLACE_BITS = np.uint64(24)
PLACE = np.uint64((1 << 24) - 1)
HEAVY_BIT = np.uint64(1 << 63)
#: The end of the one span of a document whose whole text an earlier one has.
WHOLE = 1 << 62
#: Shuffle partitions at most; beyond, one holds several buckets, sorted, and its task takes them one by one.
PARTITIONS = 1 << 14


def compress(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def decompress(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays or bytes one after the other, zstd-compressed. Non-negative integers take the fewest bytes that hold their maximum."""
    head, body = [], []
    for x in arrays:
        if isinstance(x, bytes):
            head.append((0, len(x), 0))
            body.append(x)
        else:
            low = int(x.min()) if len(x) else 0
            top = int(x.max()) - low if len(x) else 0
            width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
            head.append((width, len(x), low))
            planes = (x - x.dtype.type(low)).astype(f"<u{width}").view(np.uint8).reshape(-1, width)
            body.append(np.ascontiguousarray(planes.T).tobytes())  # bytes of one weight together compress better
    return compress(struct.pack("<i", len(head)) + b"".join(struct.pack("<iqq", *h) for h in head) + b"".join(body))


def unpack(blob: bytes) -> list[np.ndarray | bytes]:
    """What pack() took; integers come back as int64."""
    data = decompress(blob)
    (n,) = struct.unpack_from("<i", data)
    at, out = 4 + 20 * n, []
    for i in range(n):
        width, size, low = struct.unpack_from("<iqq", data, 4 + 20 * i)
        if not width:
            out.append(data[at : at + size])
            at += size
        else:
            planes = np.frombuffer(data, np.uint8, size * width, at).reshape(width, size)
            out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64) + low)
            at += size * width
    return out


def drained(held: list) -> Iterator:
    """The items in their order; the list gives up each before the next is asked for."""
    held.reverse()
    while held:
        yield held.pop()


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of documents, sorted, those that overlap or touch made one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    first = np.ones(len(doc), bool)
    # the farthest end so far within each document: shift documents apart so that one running maximum serves all
    change = np.concatenate(([True], doc[1:] != doc[:-1]))
    gap = int(end.max()) + 1
    shift = (np.cumsum(change) - 1) * gap
    reach = np.maximum.accumulate(end + shift)
    first[1:] = (start + shift)[1:] > reach[:-1]
    first |= change
    at = np.flatnonzero(first)
    last = np.concatenate((at[1:], [len(doc)])) - 1
    return doc[at], start[at], reach[last] - shift[last]


#: One row a span, so that a document has as many rows as it has repeats, whatever the number of buckets they were found in.
SPANS = "uid long, start long, end long"


def span_rows(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
    """SPANS rows; those that overlap or touch made one."""
    columns = merged(doc, start, end)
    if len(doc):
        yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["uid", "start", "end"])


def with_copies(docs: DataFrame, found: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """SPANS of docs (uid, doc_id, text): what `found` finds in the first document of each text, and [0, WHOLE) for its copies.

    A text that many documents have is thus looked at once and its copies cost one row each, however many strings it has.
    Texts are told apart by SHA-256. Copies leave the documents by an anti-join of ids, which Spark broadcasts if their
    table is below its threshold; beyond, texts travel once more.
    """
    from plumbline.llm._common import join_keys, written  # not at the top: this module travels to executors, sessions don't

    hashed = written(docs.select("uid", F.unhex(F.sha2("text", 256)).alias("sha")), "hashes")
    groups = hashed.groupBy("sha").agg(F.min("uid").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = written(join_keys(hashed, groups, "sha", hashed.count()).filter("uid > first").select("uid"), "copies")
    single = docs.join(copies, "uid", "left_anti")
    whole = copies.select("uid", F.lit(0).cast("long").alias("start"), F.lit(WHOLE).cast("long").alias("end"))
    return found(single).unionByName(whole)


def cut(docs: DataFrame, spans: DataFrame, edit: Callable[[bytes, list[tuple[int, int]] | None], tuple], schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """Every row of docs (uid, doc_id, text, others) edited by its document's spans: (doc_id, *schema, others). None instead of spans: a copy of an earlier text.

    Texts travel to the join compressed. A document's spans are as many as its text allows, so no group is unbounded.
    """

    others = docs.columns[3:]
    kept = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in others)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = pa.array([compress(x.as_py().encode()) for x in part.column(2)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts, *part.columns[3:]], names=["uid", "doc_id", "packed", *others])

    gathered = spans.groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    small = docs.select("uid", "doc_id", "text", *others).mapInArrow(tidied(shrink), "uid long, doc_id long, packed binary" + kept)
    rows = small.join(gathered, "uid", "left").select("doc_id", "packed", "spans.start", "spans.end", *others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part, out = batch.slice(at, 1000), []
                for packed, a, b in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    if b and b[0] == WHOLE:
                        out.append(edit(decompress(packed), None))
                        continue
                    a, b = np.array(a or [], np.int64), np.array(b or [], np.int64)
                    _, a, b = merged(np.zeros(len(a), np.int64), a, b)
                    out.append(edit(decompress(packed), list(zip(a.tolist(), b.tolist(), strict=True))))
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, *part.columns[4:]], names=["doc_id", *(f"c{i}" for i in range(len(kinds))), *others])

    return rows.mapInArrow(tidied(run), f"doc_id long, {schema}{kept}")


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def survey(docs: DataFrame, look: Callable[[Iterator[tuple[int, str]]], Iterator[tuple[str, np.ndarray, np.ndarray]]]) -> tuple[int, np.ndarray, np.ndarray]:
    """(all runs, hashes of heavy minimisers, sampled keys) from one pass over all texts.

    `look` yields, for each flush, ("run", hash of minimiser, count) and ("key", ...) arrays. A minimiser whose share of all
    runs is 2 * HEAVY_SHARE reaches HEAVY_SHARE in some flush, so each flush need name only those that do: at most
    1 / HEAVY_SHARE of them, and as few reach that share of the whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = ((u, t) for b in batches for u, t in zip(b.column(0).to_pylist(), (x.as_py() for x in b.column(1)), strict=True))
        for kind, keys, counts in look(texts):
            yield pa.RecordBatch.from_arrays([pa.array([kind] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], names=["kind", "key", "n"])

    from plumbline.llm._common import written  # not at the top: this module travels to executors, sessions don't

    found = docs.select("uid", "text").mapInArrow(tidied(run), "kind string, key long, n long")
    summed = found.groupBy("kind", "key").agg(F.sum("n").alias("n"))
    table = written(summed, "survey")
    total = table.filter(F.col("kind") == "all").agg(F.sum("n")).first()[0] or 0
    heavy = table.filter((F.col("kind") == "run") & (F.col("n") >= F.lit(max(32.0, HEAVY_SHARE * total)))).select("key").toArrow()["key"].to_numpy()
    cuts = table.filter(F.col("kind") == "key").agg(F.percentile_approx("key", [i / RANGES for i in range(1, RANGES)], 10 * RANGES)).first()[0] or []
    return int(total), np.sort(heavy.astype(np.int64).view(np.uint64)), np.array(cuts, np.int64)


def blob_rows(rows: Iterator[tuple[int, bool, bytes]]) -> Iterator[pa.RecordBatch]:
    """(bucket, open, blob) rows for exchange(), BATCH_BYTES at a time."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        kinds = (pa.int32(), pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=["bucket", "open", "blob"])

    for row in rows:
        held.append(row)
        size += len(row[2])
        if size >= BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


#: Ranges that splitters cut the keys into; more buckets than ranges are made by hash within a range.
RANGES = 1024


def exchange(rows: DataFrame, buckets: int, take: Callable[[list[bytes]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """SPANS that `take` finds in the blobs of each bucket of rows (bucket int, open boolean, blob binary).

    Blobs that aren't open hold spans found already. A partition holds one bucket, or several in their order.
    """
    parts = min(buckets, PARTITIONS)
    dealt = rows.repartitionById(parts, F.pmod("bucket", F.lit(parts)))
    dealt = dealt.sortWithinPartitions("bucket") if parts < buckets else dealt

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for number, is_open, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                blob = blob.as_py()
                if not is_open:
                    yield from span_rows(*unpack(blob))
                    continue
                if number != at and held:
                    yield from take(held)
                    held = []
                at = number
                held.append(blob)
            del batch
        if held:
            yield from take(held)

    return dealt.mapInArrow(tidied(run), SPANS)
