"""Substring dedup by super-k-mers: windows of WINDOW words, counted exactly in the buckets of their minimisers.

The minimiser of a window is the gram of GRAM words with the least hash (the leftmost of equals). Consecutive windows of a
document that share it are a super-k-mer: they travel as one packed string, the words joined by one space, to the bucket
that the minimiser's hash names. Windows alike have minimisers alike, so each bucket can count its windows alone: it sorts
them by hash, then by document, and compares the words themselves wherever hashes agree. Super-k-mers alike that follow
each other (a text with a period: rulers, padding) travel as one, with the number of windows in all.

Copies of whole texts are decided by the texts' SHA-256 beforehand: only the first of them is split. A task decides at once
what it can: a super-k-mer whose words stand in an earlier document among the texts at hand goes no further, so that a
passage in very many documents leaves a task once. Minimisers with a large share of all super-k-mers (found in a pass over
all texts) serve only windows that hold no other, so that a common line doesn't draw its varied surroundings into one bucket.

Defined results: words are runs of other than the six ASCII white-space bytes, unchanged; null counts as a text without
words; texts of fewer than WINDOW words have no windows; a window that repeats within its own document only stays; of
repeated rows (doc_id and text alike) each returns the same as one document, and they don't remove each other; documents
under one id come in the order of their texts' SHA-256; null ids come last.
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
from plumbline.llm.suffixes import _heavy_table, ranked_keys, runs_of, stretches

WINDOW = 13
GRAM = 3
WIDTH = WINDOW - GRAM + 1
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]  # odd, one for each word of a gram
_NOT_SPACE = ~K.SPACES
#: Bytes that a word counts for at least where buckets are sized: the arrays over words are larger than short words.
_LEAST_WORD = 7


def _pieces(texts: Iterator[tuple[int, str | None]]) -> Iterator[tuple[tuple[int, int], bytes]]:
    """((uid, number of the first word), words joined by spaces); pieces of one text overlap by WINDOW - 1 words."""
    for uid, text in texts:
        data = (text or "").encode()
        at, number, carry = 0, 0, []
        while at < len(data):
            end = at + R.CHUNK_BYTES
            if end < len(data):
                while end < len(data) and not K.SPACES[data[end]]:
                    end += 1
            words = carry + data[at:end].split()
            if len(words) >= WINDOW:
                yield (uid, number), b" ".join(words)
            carry = words[-(WINDOW - 1) :]
            number += len(words) - len(carry)
            at = end


def _words_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words."""
    a, b = K.word_bounds(np.frombuffer(data, np.uint8), _NOT_SPACE)
    return a, b, K.word_hashes(data, a, b)


class _Flush:
    """The super-k-mers of some texts: columns of equal length, offsets into `data`.

    `count` windows are in the string; `full` are in the text, the rest being those again.
    """

    NAMES = ("hash", "gram", "uid", "pos", "count", "full", "at", "end")

    def __init__(self, pieces: list[tuple[tuple[int, int], bytes]], table: np.ndarray | None) -> None:
        columns, buffers, base = [], [], 0
        for keys, parts in K.grouped(pieces, R.CHUNK_BYTES):
            data = b"\n".join(parts)
            starts = np.cumsum([0, *(len(x) + 1 for x in parts[:-1])])
            a, b, words = _words_of(data)
            prefix = K.prefix_hash(words)
            n = len(words) - GRAM + 1
            grams = sum((words[j : j + n] * f for j, f in enumerate(_FACTORS)), np.zeros(n, np.uint64))
            grams = K.mix64(grams)
            piece = np.searchsorted(starts, a, "right") - 1
            valid = np.zeros(len(words), bool)
            valid[: len(words) - WINDOW + 1] = piece[: len(words) - WINDOW + 1] == piece[WINDOW - 1 :]
            first, count, anchor = runs_of(ranked_keys(grams, table), WIDTH, valid)
            uid, number = np.array(keys, np.int64).reshape(-1, 2).T
            began = np.searchsorted(a, starts)  # first word of each piece
            at, end = a[first], b[first + count + WINDOW - 2]
            hashes = K.slice_hash(prefix, first, first + count + WINDOW - 1)
            heads, times = stretches(first, count, hashes, data, at, end)
            first, count, at, end = first[heads], count[heads], at[heads], end[heads]
            place = piece[first]
            columns.append((hashes[heads], grams[anchor[heads]], uid[place], number[place] + first - began[place], count, times * count, at + base, end + base))
            buffers.append(data)
            base += len(data)
        self.data = b"".join(buffers)
        empty = np.zeros(0, np.int64)
        found = [np.concatenate(c) for c in zip(*columns, strict=True)] if columns else [empty.view(np.uint64), empty.view(np.uint64), *[empty] * 6]
        for name, column in zip(self.NAMES, found, strict=True):
            setattr(self, name, column)

    def keep(self, rows: np.ndarray) -> None:
        for name in self.NAMES:
            setattr(self, name, getattr(self, name)[rows])

    def strings(self, rows: np.ndarray | slice) -> list[bytes]:
        return [self.data[i:j] for i, j in zip(self.at[rows].tolist(), self.end[rows].tolist(), strict=True)]

    def decide(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes out the super-k-mers that stand in an earlier document among these texts; their spans of words."""
        some = K.repeats(self.hash)
        order = some[np.lexsort((self.uid[some], self.hash[some]))]
        h, uid = self.hash[order], self.uid[order]
        first = np.concatenate(([True], h[1:] != h[:-1]))[: len(h)]
        leader = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
        later = np.flatnonzero(uid > uid[leader])
        ours, theirs = order[later], order[leader[later]]
        alike = np.fromiter((x == y for x, y in zip(self.strings(ours), self.strings(theirs), strict=True)), bool, len(ours))
        gone = ours[alike]
        spans = self.uid[gone], self.pos[gone], self.pos[gone] + self.full[gone] + WINDOW - 1
        stays = np.ones(len(self.hash), bool)
        stays[gone] = False
        self.keep(stays)
        return spans


def _flushes(texts: Iterator[tuple[int, str | None]], table: np.ndarray | None) -> Iterator[_Flush]:
    held, size = [], 0
    for piece in _pieces(texts):
        held.append(piece)
        size += len(piece[1])
        if size >= R.FLUSH_BYTES:
            yield _Flush(held, table)
            held, size = [], 0
    if held:
        yield _Flush(held, table)


def _look(texts: Iterator[tuple[int, str | None]]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    for flush in _flushes(texts, None):
        n = len(flush.gram)
        if n:
            grams, counts = np.unique(flush.gram, return_counts=True)
            many = counts >= max(2, n * R.HEAVY_SHARE)
            yield "run", grams[many], counts[many]
            yield "all", np.zeros(1, np.uint64), np.array([int(np.maximum(flush.end - flush.at, _LEAST_WORD * (flush.count + WINDOW - 1)).sum())])


def repeated_windows(blobs: list[bytes], uid: np.ndarray, pos: np.ndarray, count: np.ndarray, full: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (uid, first word, end) of the windows in the lines of the blobs (super-k-mers) that also start in a document with a smaller uid."""
    parts, base = [], 0
    for blob in blobs:
        parts.append(_words_of(blob))
        parts[-1][0][:] += base
        parts[-1][1][:] += base
        base += len(blob) + 1
    a, b, words = (np.concatenate(x) for x in zip(*parts, strict=True))
    data = b"\n".join(blobs)
    del parts
    began = np.concatenate(([0], np.cumsum(count + WINDOW - 1)[:-1]))
    line = np.repeat(np.arange(len(count)), count)
    within = np.arange(len(line)) - np.repeat(np.cumsum(count) - count, count)
    at = began[line] + within
    prefix = K.prefix_hash(words)
    h = K.slice_hash(prefix, at, at + WINDOW)
    some = K.repeats(h)
    order = some[np.lexsort((uid[line[some]], h[some]))]
    h, owner, at = h[order], uid[line[order]], at[order]
    first = np.concatenate(([True], h[1:] != h[:-1]))[: len(h)]
    leader = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    later = np.flatnonzero(owner > owner[leader])
    x, y = a[at[later]].tolist(), b[at[later] + WINDOW - 1].tolist()
    u, v = a[at[leader[later]]].tolist(), b[at[leader[later]] + WINDOW - 1].tolist()
    alike = np.fromiter((data[i:j] == data[k:m] for i, j, k, m in zip(x, y, u, v, strict=True)), bool, len(later))
    flagged = np.zeros(len(h), bool)
    flagged[later[alike]] = True
    for group in np.unique(leader[later[~alike]]).tolist():  # different words under one hash
        rows = np.flatnonzero(leader == group).tolist()
        least: dict[bytes, int] = {}
        for r in rows:
            least.setdefault(data[a[at[r]] : b[at[r] + WINDOW - 1]], int(owner[r]))
        for r in rows:
            flagged[r] = owner[r] > least[data[a[at[r]] : b[at[r] + WINDOW - 1]]]
    line, within = line[order][flagged], within[order][flagged]
    owner, first, end = uid[line], pos[line] + within, pos[line] + within + WINDOW
    extra = np.flatnonzero(full[line] > count[line])
    if len(extra):  # each of them stands there again after every period
        more = [(owner[i], np.arange(first[i], pos[line[i]] + full[line[i]], count[line[i]])) for i in extra.tolist()]
        again = np.concatenate([x for _, x in more])
        owner = np.concatenate((owner, np.repeat([u for u, _ in more], [len(x) for _, x in more])))
        first, end = np.concatenate((first, again)), np.concatenate((end, again + WINDOW))
    return owner, first, end


def _take(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    """R.SPANS of one bucket."""
    data, *columns = zip(*map(R.unpack, blobs), strict=True)
    yield from R.span_rows(*repeated_windows(list(data), *map(np.concatenate, columns)))


def _found(docs: DataFrame) -> DataFrame:
    """R.SPANS of (uid, doc_id, text), in words. A document may have several rows."""
    total, heavy, _ = R.survey(docs, _look)
    buckets = max(1, math.ceil(total / R.BUCKET_BYTES))
    shared = docs.sparkSession.sparkContext.broadcast(heavy)  # at most 2**18 hashes

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = ((u, x.as_py()) for b in batches for u, x in zip(b.column(0).to_pylist(), b.column(1), strict=True))
        for number, flush in enumerate(_flushes(texts, _heavy_table(shared.value))):
            spans = flush.decide()
            rows = [(number % buckets, False, R.pack(*spans))] if len(spans[0]) else []
            bucket = (K.mix64(flush.gram) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")  # within a bucket, super-k-mers keep the order of the texts
            flush.keep(order)
            bucket = bucket[order]
            edges = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
            for i, j in zip(edges, [*edges[1:], len(bucket)], strict=False):  # no edges, no buckets
                rows.append((int(bucket[i]), True, R.pack(b"\n".join(flush.strings(slice(i, j))), flush.uid[i:j], flush.pos[i:j], flush.count[i:j], flush.full[i:j])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.bool_(), pa.binary()), strict=True)], names=["bucket", "open", "blob"])

    rows = docs.select("uid", "text").mapInArrow(tidied(split), "bucket int, open boolean, blob binary")
    return R.exchange(rows, buckets, _take)


def repeat_spans(docs: DataFrame) -> DataFrame:
    """R.SPANS of (uid, doc_id, text) in words: those covered by windows that start in an earlier document too. A document may have several rows."""
    return R.with_copies(docs, _found)


def _kept(data: bytes, spans: list[tuple[int, int]] | None) -> tuple[int, bytes]:
    words, kept, at = data.split(), [], 0
    if spans is None:  # a copy
        spans = [(0, len(words))] if len(words) >= WINDOW else []
    for a, b in spans:
        kept += words[at:a]
        at = b
    kept += words[at:]
    return len(words), len(words) - len(kept), b" ".join(kept)


def _digest(data: bytes, spans: list[tuple[int, int]] | None) -> tuple:
    n, removed, kept = _kept(data, spans)
    return n, removed, R.sha256(kept)


def _kept_text(data: bytes, spans: list[tuple[int, int]] | None) -> tuple:
    return (_kept(data, spans)[2].decode(),)


def cut_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of docs."""
    base, unique = distinct_documents(docs)
    spans = repeat_spans(base if unique else base.dropDuplicates(["uid"]))
    return R.cut(base, spans, _digest, "n_words long, n_removed long, kept_sha256 string", [pa.int64(), pa.int64(), pa.string()])


def deduplicated(docs: DataFrame) -> DataFrame:
    """Every row of docs with its text cut (the kept words joined by one space); other columns unchanged."""
    names = docs.columns
    rest = tuple(c for c in names if c not in ("doc_id", "text"))
    base, unique = distinct_documents(docs, rest)
    spans = repeat_spans(base if unique else base.dropDuplicates(["uid"]))
    rows = R.cut(base, spans, _kept_text, "text string", [pa.string()])
    return rows.toDF("doc_id", "text", *rest).select(*(f"`{c}`" for c in names))
