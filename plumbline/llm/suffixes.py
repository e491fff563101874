"""Suffix-array dedup: a distributed merge sort of sparse suffixes that never compares a known prefix again.

Every string of LENGTH bytes holds LENGTH - DEPTH + 1 substrings of DEPTH bytes; the one with the least hash (the leftmost
of equals) is its anchor. Strings alike have anchors alike, so it is enough to sort the suffixes that begin at anchors -
one in about 39 positions - by their first DEPTH bytes, and to compare strings only where these agree.

Copies of whole texts are decided by the texts' SHA-256 beforehand: only the first of them goes through what follows.

1. Each task takes texts of about FLUSH_BYTES, finds the anchors and, for each, the run of consecutive strings that share
   it. Of runs alike that follow each other (a period), the first travels: the others stand later in their document. A run whose bytes occur earlier among these texts is decided at once and travels no further, so that a passage in
   very many documents leaves a task once. The other suffixes are sorted and front-coded (length of the prefix shared
   with the suffix before, then the rest up to DEPTH) with the run's other bytes beside them, by range of their first
   bytes.
2. The sorted runs of a range meet in one task, where a loser tree merges them. Each contender carries the length of the
   prefix it shares with the last winner; the longer one wins unseen, and only equals are compared, from that length on.
3. Suffixes that share all DEPTH bytes are a group. Within a group, the strings themselves are compared, whole.
4. Spans of strings that occur earlier are gathered by document and cut from the whole texts.

Minimisers with a large share of all anchors (found in a pass over all texts) serve only windows that hold no other: a
common line doesn't draw its varied surroundings into one range.

Defined results: null counts as empty; texts shorter than LENGTH bytes have no strings; of repeated rows (doc_id and text
alike) each returns the same as one document, and they don't remove each other; documents under one id come in the order
of their texts' SHA-256; null ids come last. Bytes mean UTF-8; a cut may fall inside a code point, and `deduplicated` then
keeps that code point whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm import _kernels as K
from plumbline.llm import _repeats as R
from plumbline.llm._common import distinct_documents
from plumbline.llm._workers import tidied

LENGTH = 100
DEPTH = 24
WIDTH = LENGTH - DEPTH + 1
_SIGN = np.uint64(1 << 63)


def _heavy_table(heavy: np.ndarray) -> np.ndarray | None:
    """Marks by the hash's lower bits; a hash that shares them with a heavy one counts as heavy everywhere alike."""
    if not len(heavy):
        return None
    table = np.zeros(1 << 22, bool)
    table[(heavy & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
    return table


def ranked_keys(grams: np.ndarray, table: np.ndarray | None) -> np.ndarray:
    """The grams' hashes as keys: heavy bit, rank, place."""
    keys = (grams >> np.uint64(1)) & ~R.PLACE & ~R.HEAVY_BIT
    keys |= np.arange(len(grams), dtype=np.uint64)
    if table is not None:
        keys |= table[(grams & np.uint64((1 << 22) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(63)
    return keys


def runs_of(keys: np.ndarray, width: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor) of the runs of consecutive valid windows with one anchor."""
    least = K.sliding_min(keys, width)
    windows = np.flatnonzero(valid[: len(least)])
    if not len(windows):
        return windows, windows, windows
    anchor = (least[windows] & R.PLACE).astype(np.int64)
    fresh = np.ones(len(windows), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)
    at = np.flatnonzero(fresh)
    return windows[at], np.diff(np.append(at, len(windows))), anchor[at]


def stretches(first: np.ndarray, count: np.ndarray, hashes: np.ndarray, data: bytes, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first run, number of runs) of the stretches of runs that follow each other without a gap and hold the same bytes, data[at:end].

    A text that repeats itself with a period below the minimiser's width makes one run a period, all alike.
    """
    alike = (hashes[1:] == hashes[:-1]) & (count[1:] == count[:-1]) & (first[1:] == first[:-1] + count[:-1])
    some = np.flatnonzero(alike)
    places = zip(at[some].tolist(), end[some].tolist(), at[some + 1].tolist(), end[some + 1].tolist(), strict=True)
    alike[some] = np.fromiter((data[a:b] == data[c:d] for a, b, c, d in places), bool, len(some))
    heads = np.flatnonzero(np.concatenate(([True], ~alike))[: len(first)])
    return heads, np.diff(np.append(heads, len(first)))


def _pieces(texts: Iterator[tuple[int, str | None]]) -> Iterator[tuple[tuple[int, int], bytes]]:
    """((uid, offset), bytes); pieces of one text overlap by LENGTH - 1 bytes, so that each string is in one piece."""
    for uid, text in texts:
        data = (text or "").encode()
        for at in range(0, max(1, len(data) - LENGTH + 1), R.CHUNK_BYTES):
            piece = data[at : at + R.CHUNK_BYTES + LENGTH - 1]
            if len(piece) >= LENGTH:
                yield (uid, at), piece


class _Flush:
    """The runs of some texts: columns of equal length, offsets into `data`. Empties `pieces`."""

    def __init__(self, pieces: list[tuple[tuple[int, int], bytes]], table: np.ndarray | None) -> None:
        columns, inner, buffers, base = [[] for _ in range(7)], [], [], 0
        for keys, parts in K.grouped(R.drained(pieces), R.CHUNK_BYTES):
            buf, data, starts = K.joined(parts, b"")
            prefix = K.prefix_hash(buf)
            grams = prefix[DEPTH:] - prefix[:-DEPTH]
            grams *= K.powers(len(prefix), K._INVERSE)[: len(grams)]
            grams = K.mix64(grams)
            sizes = np.diff(np.append(starts, len(buf)))
            edge = np.zeros(len(buf) + 1, np.int8)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + sizes - LENGTH + 1, -1)
            first, count, anchor = runs_of(ranked_keys(grams, table), WIDTH, np.cumsum(edge[:-1]).astype(bool))
            place = np.searchsorted(starts, first, "right") - 1
            uid, offset = np.array(keys, np.int64).reshape(-1, 2).T
            pos = offset[place] + first - starts[place]
            hashes = K.slice_hash(prefix, first, first + count + LENGTH - 1)
            heads, times = stretches(first, count, hashes, data, first, first + count + LENGTH - 1)
            more = heads[times > 1]
            inner.append(R.merged(uid[place[more]], pos[more] + count[more], pos[more] + (times * count[heads])[times > 1] + LENGTH - 1))
            own = (hashes[heads], grams[anchor[heads]], uid[place[heads]], pos[heads], count[heads], first[heads] + base, anchor[heads] + base)
            for column, x in zip(columns, own, strict=True):
                column.append(x)
            buffers.append(data)
            base += len(data)
        self.data = b"".join(buffers)
        buffers.clear()
        empty = np.zeros(0, np.int64)
        #: spans of the runs that repeat the run before
        self.inner = tuple(np.concatenate(x) for x in zip(*inner, strict=True)) if inner else (empty, empty, empty)
        whole = (np.concatenate(c) if c else empty for c in R.drained(columns))  # each column's parts go before the next is made
        self.hash, self.gram, self.uid, self.pos, self.count, self.at, self.anchor = whole
        self.hash, self.gram = self.hash.view(np.uint64), self.gram.view(np.uint64)

    def keep(self, rows: np.ndarray, names: tuple[str, ...] = ("hash", "gram", "uid", "pos", "count", "at", "anchor")) -> None:
        for name in names:
            setattr(self, name, getattr(self, name)[rows])

    def bytes_of(self, rows: np.ndarray) -> list[bytes]:
        a = self.at[rows]
        return [self.data[i:j] for i, j in zip(a.tolist(), (a + self.count[rows] + LENGTH - 1).tolist(), strict=True)]

    def decide(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes out the runs whose bytes stand earlier in these texts; their spans, and `inner`."""
        some = K.repeats(self.hash)
        order = some[np.lexsort((self.pos[some], self.uid[some], self.hash[some]))]
        h = self.hash[order]
        first = np.concatenate(([True], h[1:] != h[:-1]))[: len(h)]
        if not len(some):
            return self.inner
        leader = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
        same = np.flatnonzero(~first)
        ours, theirs = order[same], order[leader[same]]
        alike = np.fromiter((x == y for x, y in zip(self.bytes_of(ours), self.bytes_of(theirs), strict=True)), bool, len(ours))
        gone = ours[alike]
        spans = tuple(np.concatenate(x) for x in zip((self.uid[gone], self.pos[gone], self.pos[gone] + self.count[gone] + LENGTH - 1), self.inner, strict=True))
        stays = np.ones(len(self.hash), bool)
        stays[gone] = False
        self.keep(stays)
        return spans

    def key_bytes(self) -> np.ndarray:
        """The first DEPTH bytes of each suffix."""
        buf = np.frombuffer(self.data, np.uint8)
        out = np.empty((len(self.anchor), DEPTH), np.uint8)
        for j in range(DEPTH):
            out[:, j] = buf[self.anchor + j]
        return out


def _words(key_bytes: np.ndarray) -> list[np.ndarray]:
    """The key as big-endian numbers, whose order is that of the bytes."""
    return list(np.ascontiguousarray(key_bytes).view(">u8").astype(np.uint64).T)


def _flushes(texts: Iterator[tuple[int, str | None]], table: np.ndarray | None) -> Iterator[_Flush]:
    held, size = [], 0
    for piece in _pieces(texts):
        held.append(piece)
        size += len(piece[1])
        if size >= R.FLUSH_BYTES:
            yield _Flush(held, table)
            size = 0
    if held:
        yield _Flush(held, table)


def _look(texts: Iterator[tuple[int, str | None]]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    for flush in _flushes(texts, None):
        n = len(flush.gram)
        if n:
            grams, counts = np.unique(flush.gram, return_counts=True)
            many = counts >= max(2, n * R.HEAVY_SHARE)
            yield "run", grams[many], counts[many]
            yield "all", np.zeros(1, np.uint64), np.array([n])
            heads = np.sort(_words(flush.key_bytes())[0] ^ _SIGN)[:: max(1, n // 512)]
            yield "key", heads, np.ones(len(heads), np.int64)
        del flush


def encode_run(keys: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Front coding of sorted keys (n, DEPTH): length of the prefix shared with the key before, and the bytes after it."""
    shared = np.zeros(len(keys), np.int64)
    if len(keys) > 1:
        equal = keys[1:] == keys[:-1]
        shared[1:] = np.where(equal.all(axis=1), keys.shape[1], equal.argmin(axis=1))
    return shared, keys[np.arange(keys.shape[1])[None, :] >= shared[:, None]].tobytes()


def decode_run(shared: np.ndarray, tails: bytes, depth: int = DEPTH) -> np.ndarray:
    told = np.arange(depth)[None, :] >= shared[:, None]
    keys = np.zeros((len(shared), depth), np.uint8)
    keys[told] = np.frombuffer(tails, np.uint8)
    rows = np.arange(len(shared))
    for j in range(depth):
        keys[:, j] = keys[np.maximum.accumulate(np.where(told[:, j], rows, 0)), j]
    return keys


def merge_runs(runs: list[tuple[list[int], list[list[int]]]]) -> Iterator[tuple[int, int, int]]:
    """(run, index, prefix shared with the item before) in the order of the keys, then of the runs.

    runs: for each, the shared-prefix lengths and the keys as columns of 64-bit words. A loser tree: `shares[r]` is the
    length of the prefix that run r's head shares with the winner it last lost to or followed, so bytes before it are
    never looked at again.
    """
    runs_n = len(runs)
    if not runs_n:
        return
    size = 1 << max(0, runs_n - 1).bit_length()
    lengths = [len(r[0]) for r in runs] + [0] * (size - runs_n)
    at, shares = [0] * size, [0] * size
    columns = [r[1] for r in runs]
    words = len(columns[0])
    full = 8 * words
    alive = [n > 0 for n in lengths]

    def beats(a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; the loser's share becomes what it has in common with the winner."""
        if not alive[b]:
            return True
        if not alive[a]:
            return False
        p, q = shares[a], shares[b]
        if p != q:
            return p > q
        x, y, i, j = columns[a], columns[b], at[a], at[b]
        for w in range(p >> 3, words):
            u, v = x[w][i], y[w][j]
            if u != v:
                same = 8 * w + ((64 - (u ^ v).bit_length()) >> 3)
                if u < v:
                    shares[b] = same
                    return True
                shares[a] = same
                return False
        if a < b:
            shares[b] = full
            return True
        shares[a] = full
        return False

    tree = [0] * size

    def build(node: int) -> int:
        if node >= size:
            return node - size
        one, other = build(2 * node), build(2 * node + 1)
        if beats(one, other):
            tree[node] = other
            return one
        tree[node] = one
        return other

    winner = build(1) if size > 1 else 0
    while alive[winner]:
        i = at[winner]
        yield winner, i, shares[winner]
        i += 1
        at[winner] = i
        if i < lengths[winner]:
            shares[winner] = runs[winner][0][i]
        else:
            alive[winner] = False
        node = (winner + size) >> 1
        while node:
            if beats(tree[node], winner):
                winner, tree[node] = tree[node], winner
            node >>= 1


def _repeats(group: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, int]]:
    """Spans of the strings in a group's runs (uid, pos, number of strings, bytes) that stand earlier in it."""
    best: dict[bytes, tuple[int, int, int]] = {}
    for uid, pos, count, data in group:
        other = best.get(data)
        if other is None:
            best[data] = (uid, pos, count)
        elif (uid, pos) < other[:2]:
            best[data] = (uid, pos, count)
            yield other[0], other[1], other[1] + count + LENGTH - 1
        else:
            yield uid, pos, pos + count + LENGTH - 1
    if len(best) < 2:
        return
    first: dict[bytes, tuple[int, int]] = {}
    for data, (uid, pos, count) in best.items():
        for i in range(count):
            string, own = data[i : i + LENGTH], (uid, pos + i)
            if first.setdefault(string, own) > own:
                first[string] = own
    for data, (uid, pos, count) in best.items():
        began = -1
        for i in range(count):
            if first[data[i : i + LENGTH]] != (uid, pos + i):
                began = i if began < 0 else began
            elif began >= 0:
                yield uid, pos + began, pos + i - 1 + LENGTH
                began = -1
        if began >= 0:
            yield uid, pos + began, pos + count - 1 + LENGTH


def _merge_bucket(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    runs, sides = [], []
    for blob in R.drained(blobs):
        shared, tails, uid, pos, count, left, context = R.unpack(blob)
        keys = decode_run(shared, tails)
        runs.append((shared.tolist(), [x.tolist() for x in _words(keys)]))
        sides.append((keys.tobytes(), uid, pos, count, left, np.concatenate(([0], np.cumsum(count + LENGTH - 1 - DEPTH))), context))
    spans: list[tuple[int, int, int]] = []

    def close(members: list[tuple[int, int]]) -> None:
        group = []
        for r, i in members:
            keys, uid, pos, count, left, offset, context = sides[r]
            a, m, b = int(offset[i]), int(offset[i] + left[i]), int(offset[i + 1])
            group.append((int(uid[i]), int(pos[i]), int(count[i]), context[a:m] + keys[DEPTH * i : DEPTH * (i + 1)] + context[m:b]))
        spans.extend(_repeats(group))

    held: list[tuple[int, int]] = []
    for r, i, share in merge_runs(runs):
        if share < DEPTH:
            if len(held) > 1:
                close(held)
            held = []
        held.append((r, i))
        if len(spans) > 500_000:
            yield from R.span_rows(*np.array(spans, np.int64).T)
            spans.clear()
    if len(held) > 1:
        close(held)
    if spans:
        yield from R.span_rows(*np.array(spans, np.int64).T)


def _split(texts: Iterator[tuple[int, str | None]], heavy: np.ndarray, splitters: np.ndarray, ranges: int, within: int) -> Iterator[tuple[int, bool, bytes]]:
    """(bucket, open, blob): what is decided at once, and the packed runs of each bucket."""
    number = 0  # no enumerate(): it would hold each flush while the next is made
    for flush in _flushes(texts, _heavy_table(heavy)):
        spans = flush.decide()
        if len(spans[0]):
            yield number % (ranges * within), False, R.pack(*spans)
        number += 1
        flush.hash = flush.gram = flush.at[:0]  # not needed from here on
        keys = flush.key_bytes()
        words = _words(keys)
        bucket = np.searchsorted(splitters, (words[0] ^ _SIGN).view(np.int64), "right") * within
        if within > 1:
            bucket += (K.mix64(words[0] ^ K.mix64(words[1] ^ K.mix64(words[2]))) % np.uint64(within)).astype(np.int64)
        order = np.lexsort((flush.pos, flush.uid, words[2], words[1], words[0], bucket))
        del words
        flush.keep(order, ("uid", "pos", "count", "at", "anchor"))
        keys, bucket = keys[order], bucket[order]
        del order
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(bucket)], strict=False):  # no edges, no buckets
            at, anchor, end = flush.at[a:b], flush.anchor[a:b], flush.at[a:b] + flush.count[a:b] + LENGTH - 1
            data = flush.data
            context = b"".join([data[i:j] + data[j + DEPTH : k] for i, j, k in zip(at.tolist(), anchor.tolist(), end.tolist(), strict=True)])
            lengths, tails = encode_run(keys[a:b])
            yield int(bucket[a]), True, R.pack(lengths, tails, flush.uid[a:b], flush.pos[a:b], flush.count[a:b], anchor - at, context)
        del flush, keys, bucket
        data = context = None


def _found(docs: DataFrame) -> DataFrame:
    """R.SPANS of (uid, doc_id, text). A document may have several rows."""
    total, heavy, cuts = R.survey(docs, _look)
    buckets = max(1, math.ceil(total * (LENGTH + WIDTH // 2) / R.BUCKET_BYTES))
    ranges = min(buckets, R.RANGES)
    within = math.ceil(buckets / ranges)
    splitters = np.array([cuts[i * (len(cuts) + 1) // ranges - 1] for i in range(1, ranges)], np.int64) if len(cuts) >= ranges - 1 else cuts
    shared = docs.sparkSession.sparkContext.broadcast((heavy, splitters))  # at most 2**18 hashes and RANGES splitters

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, splitters = shared.value
        texts = ((u, x.as_py()) for b in batches for u, x in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        yield from R.blob_rows(_split(texts, heavy, splitters, ranges, within))

    rows = docs.select("uid", "text").mapInArrow(tidied(split), "bucket int, open boolean, blob binary")
    return R.exchange(rows, ranges * within, _merge_bucket)


def repeat_spans(docs: DataFrame) -> DataFrame:
    """R.SPANS of (uid, doc_id, text): the bytes of each document covered by strings that start earlier. A document may have several rows."""
    return R.with_copies(docs, _found)


def _whole(data: bytes) -> list[tuple[int, int]]:
    """The spans of a copy."""
    return [(0, len(data))] if len(data) >= LENGTH else []


def _digest(data: bytes, spans: list[tuple[int, int]] | None) -> tuple:
    spans, kept, at = _whole(data) if spans is None else spans, [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    kept = b"".join([*kept, data[at:]])
    return len(data), len(data) - len(kept), len(spans), R.sha256(kept)


def cut_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs."""
    base, unique = distinct_documents(docs)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return R.cut(base, repeat_spans(base if unique else base.dropDuplicates(["uid"])), _digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", kinds)


def _kept_text(data: bytes, spans: list[tuple[int, int]] | None) -> tuple:
    spans, kept, at = _whole(data) if spans is None else spans, [], 0
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:  # begins inside a code point: that stays
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        kept.append(data[at:a])
        at = b
    return (b"".join([*kept, data[at:]]).decode(),)


def deduplicated(docs: DataFrame) -> DataFrame:
    """Every row of docs with its text cut (the whole texts without the strings that start earlier); other columns unchanged."""
    names = docs.columns
    rest = tuple(c for c in names if c not in ("doc_id", "text"))
    base, unique = distinct_documents(docs, rest)
    spans = repeat_spans(base if unique else base.dropDuplicates(["uid"]))
    rows = R.cut(base, spans, _kept_text, "text string", [pa.string()])
    return rows.toDF("doc_id", "text", *rest).select(*(f"`{c}`" for c in names))
