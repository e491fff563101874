"""Document fingerprints: context-triggered piecewise hashing.

A rolling hash of the last 7 bytes cuts a text wherever it is `block - 1` modulo the block size; each piece gives one of
64 letters by its xxHash, so an edit changes the letters near it only. A fingerprint is `block:letters:letters at twice the block`.
Two fingerprints compare where their block sizes are equal or differ by a factor of two: 1 - indel distance / total length
of the letters at a common block size (the better of the two common sizes), where that distance counts single insertions
and deletions; otherwise their likeness is 0. Runs of more than three equal letters count as three.

Defined results: null and empty text alike have the fingerprint `3::` (likeness 1 with itself, 0 with any other);
equal texts have equal fingerprints. In `fingerprint_documents`, documents follow each other by ascending doc_id (null
first), then by their texts' hash; repeated rows are compared each with its next; a lone document is its own next. Very
long texts are hashed chunk by chunk.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from plumbline.llm._common import written
from plumbline.llm._workers import tidied

LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
LEAST_BLOCK = 3
PIECES = 64
REACH = 7
#: Bytes of a text that the rolling hash is taken of at a time.
CHUNK_BYTES = 1 << 20


def _rolling(data: bytes, at: int) -> np.ndarray:
    """The rolling hash after each of up to CHUNK_BYTES bytes from `at` on: sum, weighted sum and shifted xor of the last REACH bytes."""
    own = np.frombuffer(data, np.uint8, min(CHUNK_BYTES, len(data) - at), at)
    n = len(own)
    x = np.zeros(n + REACH - 1, np.uint32)
    x[REACH - 1 :] = own
    before = data[max(0, at - REACH + 1) : at]
    x[REACH - 1 - len(before) : REACH - 1] = np.frombuffer(before, np.uint8)
    plain, weighted, shifted = np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for back in range(REACH):
        part = x[REACH - 1 - back : REACH - 1 - back + n]
        plain += part
        weighted += part * np.uint32(REACH - back)
        shifted ^= part << np.uint32(5 * back)  # bits beyond 32 fall off: 7 bytes of context at most
    return plain + weighted + shifted


def _letters(data: bytes, first: np.ndarray, block: int, most: int) -> bytes:
    """At most `most` letters, one a piece; `first`: the rolling hash of the first chunk. Chunks are looked at until there are enough cuts."""
    cuts: list[int] = []
    for at in range(0, len(data), CHUNK_BYTES):
        roll = _rolling(data, at) if at else first
        cuts += (np.flatnonzero(roll % np.uint32(block) == np.uint32(block - 1))[: most - 1] + (at + 1)).tolist()
        if len(cuts) >= most - 1:
            break
    edges = [0, *cuts[: most - 1]]
    if edges[-1] < len(data):
        edges.append(len(data))
    view = memoryview(data)
    return bytes(LETTERS[xxhash.xxh64_intdigest(view[a:b]) & 63] for a, b in itertools.pairwise(edges))


def fingerprint(data: bytes) -> str:
    """The fingerprint of a byte string; the block size is halved until the first part has half the pieces wanted."""
    if not data:
        return f"{LEAST_BLOCK}::"
    first = _rolling(data, 0)
    block = LEAST_BLOCK
    while block * PIECES < len(data):
        block *= 2
    while True:
        one = _letters(data, first, block, PIECES)
        if block == LEAST_BLOCK or len(one) >= PIECES // 2:
            break
        block //= 2
    return f"{block}:{one.decode()}:{_letters(data, first, 2 * block, PIECES // 2).decode()}"


def _short_runs(s: str) -> str:
    return "".join(c * min(3, sum(1 for _ in g)) for c, g in itertools.groupby(s))


def indel_distance(a: str, b: str) -> int:
    """Fewest single insertions and deletions from a to b, by bit-parallel longest common subsequence."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & masks.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) + len(b) - 2 * (len(a) - row.bit_count())


def likeness(one: str, other: str) -> float:
    """0 to 1; 0 where no block size is common."""
    if one == other:
        return 1.0
    (b1, x1, y1), (b2, x2, y2) = one.split(":"), other.split(":")
    m, n = int(b1), int(b2)
    pairs = [(x1, x2), (y1, y2)] if m == n else [(y1, x2)] if 2 * m == n else [(x1, y2)] if m == 2 * n else []
    best = 0.0
    for p, q in pairs:
        p, q = _short_runs(p), _short_runs(q)
        if p and q:
            best = max(best, 1 - indel_distance(p, q) / (len(p) + len(q)))
    return best


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def edited(text: str, following: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + following[:n] if n else text


def _compared(doc: int | None, text: str, own: str, after: str, after_print: str) -> tuple:
    changed = edited(text, after).encode()
    mark = fingerprint(changed)
    return doc, len(text), hashlib.sha256(changed).hexdigest(), own, mark, likeness(own, mark), likeness(own, after_print)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NAMES)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """SCHEMA for every document against its edited text and the next document.

    One range exchange puts neighbours together. Each partition compares its rows as they stream by and hands on its
    first and last document; these few (two a partition) find each other by a join on the partitions' numbers.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # ranges are drawn from a sample of the keys, which the driver sees: a hash, not the text; the place parts repeated rows
    keyed = base.withColumn("tie", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange("doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie", "place")
    ordered = ordered.select("doc_id", "text", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        part, out = 0, []

        def packed(rows: list[tuple], ends: list[tuple] = ()) -> pa.RecordBatch:
            done = _batch(rows) if rows else None
            cols = [done.column(i) for i in range(7)] if rows else [pa.array([None] * len(ends), t) for t in (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            n = len(rows) or len(ends)
            extra = [pa.array([e[i] for e in ends] if ends else [None] * n, t) for i, t in enumerate((pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string()))]
            return pa.RecordBatch.from_arrays([*cols, *extra], names=[*_NAMES, "part", "first_id", "first_text", "last_id", "last_text"])

        for batch in batches:
            for doc, text, number in zip(*((x.as_py() for x in c) for c in batch.columns), strict=True):
                part, mark = number, fingerprint(text.encode())
                if last is not None:
                    out.append(_compared(*last, text, mark))
                else:
                    first = (doc, text)
                last = (doc, text, mark)
                if len(out) >= 2000:
                    yield packed(out)
                    out = []
        if out:
            yield packed(out)
        if first is not None:
            yield packed([], [(part, *first, last[0], last[1])])

    table = written(ordered.mapInArrow(tidied(run), SCHEMA + ", part int, first_id long, first_text string, last_id long, last_text string"), "ctph")
    ends = table.filter(F.col("part").isNotNull()).select("part", "first_text", "last_id", "last_text")
    w = Window.orderBy("part")  # one number a partition
    first = F.min("part").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    following = ends.select("part").select("part", F.coalesce(F.lead("part").over(w), first).alias("next"))
    after = ends.select(F.col("part").alias("next"), F.col("first_text").alias("after"))
    seams = ends.select("part", "last_id", "last_text").join(following, "part").join(after, "next").select("last_id", "last_text", "after")

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, t, a in zip(*((x.as_py() for x in c) for c in batch.columns), strict=True):
                yield _batch([_compared(d, t, fingerprint(t.encode()), a, fingerprint(a.encode()))])

    return table.filter(F.col("part").isNull()).select(*_NAMES).unionByName(seams.mapInArrow(tidied(stitch), SCHEMA))
