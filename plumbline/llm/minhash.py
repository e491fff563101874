"""MinHash near-dedup: a signature-coordinate inverted join.

Each document's set of word shingles gets a signature of COORDINATES minima. Documents with one set are a class, and its
smallest document stands for it. A signature is a set of (coordinate, value) tokens, and two documents whose sets are
`percent` alike share at least `needed` tokens but for a chance of MISS; so they share one among the COORDINATES - needed + 1
tokens of each that are rarest in the corpus (any order of tokens that all documents keep will do; counts come from a
sketch of bounded size). Documents are posted under these tokens only: common passages make common tokens, which fall
outside the prefix.

Posting lists are joined without their squares. The pairs of a short list are counted, those with fewer than `needed`
collisions of coordinates skipped, the rest confirmed on the full sets. A long list pairs its members with a centre only,
and the links found merge components. What such a star can miss lies in lists that still hold several components: their
documents are joined exactly, by the shingles themselves. Each orders its shingles by their number of holders, the rarest
first, and is posted under those that a partner of each class of sizes could share first; a pair is made where the places
of a shared shingle leave room for enough others (positional prefix filter), and only across components. No candidate is
dropped; pairs that can't be links, or can't change a component, are not made.

Defined results: words are runs of other than the six ASCII white-space bytes with A-Z lower-cased; a text of fewer words
than a shingle has the whole sequence as its one shingle; null or a text without words has an empty set and links to
nothing; repeated rows (doc_id and text alike) are one document, returned as often as it occurs; documents under one id
come in the order of their texts' SHA-256, null ids last. Sets are compared by 64-bit hashes of their
shingles, which are made of whole words' hashes, no
polynomials over their bytes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from plumbline.llm import _kernels as K
from plumbline.llm._common import discard, distinct_documents, join_keys, written
from plumbline.llm._workers import tidied
from plumbline.llm._repeats import compress, decompress

COORDINATES = 64
MISS = 1e-6
#: Lists of so many documents at most are joined pair by pair.
SHORT = 16
_CHUNK = 1 << 19
_NOT_SPACE = ~K.SPACES
_SLOTS = 1 << 20
_PARTS = 64
#: Tasks at most that count tokens: each sends up to 4 MB of counters.
COUNTERS = 2048


def least_matches(percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The largest number of matching coordinates that sets `percent` alike fall short of with a chance of at most miss."""
    p, below = percent / 100, 0.0
    for k in range(coordinates + 1):
        below += math.comb(coordinates, k) * p**k * (1 - p) ** (coordinates - k)
        if below > miss:
            return max(1, k)
    return coordinates


def _pieces(texts: list[str | None], k: int) -> Iterator[tuple[int, bytes]]:
    for i, text in enumerate(texts):
        data = (text or "").encode().lower()  # bytes: A-Z alone
        at, carry = 0, b""
        while len(data) - at > _CHUNK:
            end = at + _CHUNK
            while end < len(data) and not K.SPACES[data[end]]:
                end += 1
            piece = carry + data[at:end]
            yield i, piece
            carry = b"".join(w + b" " for w in piece[-(1 << 16) :].split()[-(k - 1) :]) if k > 1 else b""
            if k > 1 and len(piece[-(1 << 16) :].split()) < k:
                carry = b" ".join(piece.split()[-(k - 1) :]) + b" "
            at = end
        yield i, carry + data[at:]


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's different shingles of k words."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    short: dict[int, np.ndarray] = {}  # the whole sequence of a text's last piece of fewer than k words; it carries all words so far
    factors = K.powers(k + 1, 0xC2B2AE3D27D4EB4F)[1:]
    for keys, parts in K.grouped(_pieces(texts, k), _CHUNK):
        buf, data, starts = K.joined(parts)
        a, b = K.word_bounds(buf, _NOT_SPACE)
        words = K.word_hashes(data, a, b)
        n = max(0, len(words) - k + 1)
        grams = np.zeros(n, np.uint64)
        for j in range(k):
            grams += words[j : j + n] * factors[j]
        grams = K.mix64(grams)
        edges = [*np.searchsorted(a, starts).tolist(), len(a)]
        for key, i, j in zip(keys, edges[:-1], edges[1:], strict=True):
            if j - i >= k:
                found[key].append(K.distinct(grams[i : j - k + 1]))
            elif j > i and not found[key]:
                whole = K.slice_hash(K.prefix_hash(words[i:j]), np.array([0]), np.array([j - i]))
                short[key] = whole ^ np.uint64(j - i)
    for key, whole in short.items():
        if not found[key]:
            found[key].append(whole)
    return [x[0] if len(x) == 1 else K.distinct(np.concatenate(x)) if x else np.zeros(0, np.uint64) for x in found]


def _constants(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    draw = K.mix64(np.arange(1, 2 * coordinates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return draw[:coordinates] | np.uint64(1), draw[coordinates:]


def signature(hashes: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the minimum of each coordinate's multiply-add."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        values = factors[:, None] * hashes[None, at : at + 1024]
        values += shifts[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, k: int, coordinates: int = COORDINATES) -> DataFrame:
    """(uid, n, words, mark, sig) of (uid, text): size of the set, words of the text, 128-bit fingerprint and signature of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, shifts = _constants(coordinates)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                sets, words = shingle_sets(texts, k), [K.count_words((x or "").encode()) for x in texts]
                marks = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                sigs = [signature(s, factors, shifts).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, sets), pa.int64()), pa.array(words, pa.int64()), pa.array(marks, pa.binary()), pa.array(sigs, pa.binary())],
                    names=["uid", "n", "words", "mark", "sig"],
                )

    return docs.select("uid", "text").mapInArrow(tidied(run), "uid long, n long, words long, mark binary, sig binary")


def _tokens(sigs: list[bytes], coordinates: int) -> np.ndarray:
    """(documents, coordinates) of 64-bit tokens."""
    values = np.frombuffer(b"".join(sigs), np.uint32).reshape(-1, coordinates).astype(np.uint64)
    return K.mix64((values << np.uint64(16)) | np.arange(coordinates, dtype=np.uint64)[None, :])


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(44)).astype(np.int64)  # the upper 20 bits: _SLOTS of them


def token_counts(reps: DataFrame, coordinates: int) -> np.ndarray:
    """How many tokens fall in each of _SLOTS slots. Tasks send partial counts by range of slots; the driver gets _SLOTS numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SLOTS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                total += np.bincount(_slots(_tokens(batch.column(0).slice(at, 5000).to_pylist(), coordinates)).ravel(), minlength=_SLOTS)
        if total.any():
            rows = [compress(x.astype(np.uint32).tobytes()) for x in total.reshape(_PARTS, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(_PARTS), pa.int32()), pa.array(rows, pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(decompress(blob), np.uint32).astype(np.int64)
        for part, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())], names=["part", "counts"])

    partial = reps.select("sig").coalesce(COUNTERS).mapInArrow(tidied(count), "part int, counts binary")
    rows = partial.repartitionById(_PARTS, F.col("part")).mapInArrow(tidied(add), "part int, counts binary").toArrow()
    out = np.zeros((_PARTS, _SLOTS // _PARTS), np.uint32)
    for part, blob in zip(rows["part"].to_pylist(), rows["counts"].to_pylist(), strict=True):
        out[part] = np.frombuffer(blob, np.uint32)
    return out.ravel()


def postings(reps: DataFrame, counts: np.ndarray, prefix: int, coordinates: int) -> DataFrame:
    """(token, uid, score): each document under its `prefix` rarest tokens; score: how common all its tokens are."""
    shared = reps.sparkSession.sparkContext.broadcast(counts)  # _SLOTS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                tokens = _tokens(part.column(1).to_pylist(), coordinates)
                often = shared.value[_slots(tokens)].astype(np.int64)
                order = np.lexsort((tokens, often), axis=1)[:, :prefix]
                picked = np.take_along_axis(tokens, order, axis=1)
                uid = np.repeat(part.column(0).to_numpy(), picked.shape[1])
                score = np.repeat(np.log1p(often).sum(axis=1).round(6), picked.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(picked.ravel().view(np.int64)), pa.array(uid), pa.array(score)], names=["token", "uid", "score"])

    return reps.select("uid", "sig").mapInArrow(tidied(run), "token long, uid long, score double")


def matching(pairs: DataFrame, sigs: DataFrame, needed: int, coordinates: int) -> DataFrame:
    """The pairs (a, b) whose signatures collide in `needed` coordinates or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, coordinates) for i in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= needed))

    left = sigs.select(F.col("uid").alias("a"), F.col("sig").alias("x"))
    right = sigs.select(F.col("uid").alias("b"), F.col("sig").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(tidied(run), "a long, b long")


_BITS = 1 << 26


def _needed_texts(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(uid, packed) of documents that may occur in pairs, thinned by a bitmap of _BITS (8 MB) bits; what it lets through beyond them, the join drops."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("uid"))
    bit = F.pmod(F.xxhash64("uid"), F.lit(_BITS))
    rows = ids.select(F.bitmap_bucket_number(bit).alias("part"), F.bitmap_bit_position(bit).alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits")).toArrow()
    width = 4096 * 8
    table = np.zeros(_BITS // 8 + 4096, np.uint8)
    for part, bits in zip(rows["part"].to_pylist(), rows["bits"].to_pylist(), strict=True):
        at = (part * width - width) // 8 if part else 0
        table[at : at + len(bits)] |= np.frombuffer(bits, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            part, position = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            place = np.where(part > 0, part * width - width, 0) + position
            hit = (shared.value[place >> 3] >> (place & 7)) & 1
            some = batch.filter(pa.array(hit.astype(bool)))
            for i in range(0, some.num_rows, 1000):
                piece = some.slice(i, 1000)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([compress((x.as_py() or "").encode()) for x in piece.column(1)], pa.binary())], names=["uid", "packed"])
            del at

    source = docs.select("uid", "text", F.bitmap_bucket_number(bit).alias("part"), F.bitmap_bit_position(bit).alias("at"))
    return source.mapInArrow(tidied(run), "uid long, packed binary")


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, keep = batch.slice(at, 500), []
                others = shingle_sets([decompress(x).decode() for x in part.column(3).to_pylist()], k)
                for a, text, other in zip(part.column(0).to_pylist(), (x.as_py() for x in part.column(2)), others, strict=True):
                    if a != last:
                        last, own = a, shingle_sets([decompress(text).decode()], k)[0]
                    both = _shared(own, other)
                    keep.append(100 * both >= percent * (len(own) + len(other) - both))
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    texts = _needed_texts(docs, pairs)
    left = texts.select(F.col("uid").alias("a"), F.col("packed").alias("x"))
    right = texts.select(F.col("uid").alias("b"), F.col("packed").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(tidied(run), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable by links (a, b), for every node in a link. Least labels spread and are shortened until nothing changes."""
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        nearer = labels.select("node", "root").join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("root", "m").alias("root"), F.col("root").alias("old"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        step = written(nearer.join(up, "root").select("node", F.least("root", "above").alias("root"), "old"), "labels")
        discard(labels)
        labels = step
        if step.filter("root <> old").limit(1).count() == 0:
            discard(both)
            return labels


def _merge(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (uid, root) after links between documents."""
    named = links.join(comp.select(F.col("uid").alias("a"), F.col("root").alias("ra")), "a").join(comp.select(F.col("uid").alias("b"), F.col("root").alias("rb")), "b")
    roots = components(named.filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    joined = comp.join(roots, comp["root"] == roots["node"], "left")
    out = written(joined.select("uid", F.coalesce(roots["root"], comp["root"]).alias("root")), "components")
    discard(roots, comp)
    return out


_RATIO = 1.05


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sorted sets share."""
    if not len(x):
        return 0
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    return int(np.count_nonzero(x[at] == y))


def _exact_candidates(docs: DataFrame, ids: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The table to discard after use, and pairs (a, b) of documents in ids (uid, root) of different roots that may be `percent` alike, by shingles alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = shingle_sets([decompress(x).decode() for x in part.column(1).to_pylist()], k)
                sizes = np.array([len(x) for x in sets], np.int64)
                columns = [np.repeat(part.column(0).to_numpy(), sizes), np.repeat(part.column(2).to_numpy(), sizes), np.repeat(sizes, sizes)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))], names=["uid", "root", "n", "shingle"])

    texts = _needed_texts(docs, ids.select(F.col("uid").alias("a"), F.col("uid").alias("b"))).join(ids, "uid").select("uid", "packed", "root")
    held = written(texts.mapInArrow(tidied(run), "uid long, root long, n long, shingle long"), "shingles")
    often = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("holders"))
    ranked = held.join(often, "shingle").withColumn("place", F.row_number().over(Window.partitionBy("uid").orderBy("holders", "shingle")))  # one document's shingles
    reach = math.ceil(math.log(100 / percent) / math.log(_RATIO)) + 1
    own = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(_RATIO))).cast("int")
    least = lambda c: F.floor(F.pow(F.lit(_RATIO), c))
    shared = lambda x, y: F.ceil(F.lit(percent) * (x + y) / F.lit(100 + percent))
    posted = ranked.filter((F.col("holders") > 1) & (F.col("place") <= F.col("n") - F.ceil(F.lit(percent) * F.col("n") / F.lit(100)) + 1)).withColumn("own", own)
    posted = posted.withColumn("other", F.explode(F.sequence(F.greatest(F.lit(0), F.col("own") - reach), F.col("own") + reach)))
    posted = posted.filter(F.col("place") <= F.col("n") - shared(least(F.col("own")), least(F.col("other"))) + 1)
    posted = posted.select("uid", "root", "n", "place", "own", F.xxhash64("shingle", F.least("own", "other"), F.greatest("own", "other")).alias("key"), (F.col("own") == F.col("other")).alias("level"))
    # lists of one root are skipped; in others, the members of the most frequent root don't meet each other
    parts = posted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    most = parts.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").select("key", "most")
    table = written(posted.join(most, "key"), "prefixes")
    discard(held)
    posted = table
    x = posted.filter("root <> most").select("key", "level", *[F.col(c).alias(f"{c}x") for c in ("uid", "root", "n", "place", "own")])
    y = posted.select("key", "level", *[F.col(c).alias(f"{c}y") for c in ("uid", "root", "n", "place", "own")])
    room = F.lit(1) + F.least(F.col("nx") - F.col("placex"), F.col("ny") - F.col("placey")) >= shared(F.col("nx"), F.col("ny"))
    on = [x["key"] == y["key"], x["level"] == y["level"], F.col("rootx") != F.col("rooty"), x["level"] | (F.col("ownx") != F.col("owny")), room]
    return table, _sorted_pairs(x.join(y, on).select(F.col("uidx").alias("a"), F.col("uidy").alias("b")))


def _sorted_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, coordinates: int = COORDINATES) -> DataFrame:
    """(uid, n, words, root) for every different document of docs (uid, text): shingles, words, and the smallest uid of its component."""
    needed = least_matches(percent, coordinates)
    prefix = coordinates - needed + 1
    sigs = written(signatures(docs, k, coordinates), "signatures", "snappy")  # hashes: nothing to compress
    full = sigs.filter("n > 0")
    classes = full.groupBy("mark").agg(F.min("uid").alias("rep"), F.count(F.lit(1)).alias("n"))
    members = written(join_keys(full.select("uid", "mark"), classes, "mark", full.count()).select("uid", "rep"), "classes", "snappy")
    reps = written(full.join(members.filter("uid = rep").select("uid"), "uid").select("uid", "sig"), "representatives", "snappy")
    posted = written(postings(reps, token_counts(reps, coordinates), prefix, coordinates), "postings", "snappy")
    total = reps.count() * prefix
    centre = F.max_by("uid", F.struct("score", "uid")).alias("centre")
    several = posted.groupBy("token").agg(F.count(F.lit(1)).alias("n"), centre).filter("n > 1")
    lists = written(join_keys(posted.select("token", "uid"), several, "token", total), "lists", "snappy")
    discard(posted)
    comp = lists.select("uid").distinct().select("uid", F.col("uid").alias("root"))

    def linked(pairs: DataFrame, comp: DataFrame) -> DataFrame:
        pairs = written(pairs, "pairs")
        alike = written(matching(pairs, reps, needed, coordinates), "matches")
        links = written(confirmed(alike, docs, k, percent), "links")
        comp = _merge(comp, links) if links.limit(1).count() else comp
        discard(pairs, alike, links)
        return comp

    short, long = (lists.filter(F.col("n") <= SHORT), lists.filter(F.col("n") > SHORT))
    x, y = (short.select("token", F.col("uid").alias(i)) for i in ("a", "b"))
    stars = long.filter("uid <> centre").select(F.col("centre").alias("a"), F.col("uid").alias("b"))
    comp = linked(_sorted_pairs(x.join(y, "token").filter("a < b").select("a", "b").union(stars)), written(comp, "components"))
    left = long.select("token", "uid").join(comp, "uid")
    mixed = left.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("n")).filter("r0 <> r1").select("token", "n")
    ids = written(join_keys(left, mixed, "token", total).select("uid", "root").distinct(), "open")
    if ids.limit(1).count():
        prefixes, candidates = _exact_candidates(docs, ids, k, percent)
        comp = linked(candidates, comp)
        discard(prefixes)
    discard(reps, lists, ids)
    out = sigs.select("uid", "n", "words").join(members, "uid", "left")
    roots = comp.select(F.col("uid").alias("rep"), "root")
    return out.join(roots, "rep", "left").select("uid", "n", "words", F.coalesce("root", "rep", "uid").alias("root"))


def near_duplicate_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs."""
    base, unique = distinct_documents(docs)
    one = base if unique else base.dropDuplicates(["uid"])
    found = near_duplicates(one.select("uid", "text"), k, percent)
    if unique:
        return found.select(F.col("uid").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("root").alias("component_id"), (F.col("uid") == F.col("root")).alias("kept"))
    named = written(base.select("uid", "doc_id"), "ids")
    ids = named.distinct()
    roots = found.join(ids.select(F.col("uid").alias("root"), F.col("doc_id").alias("component_id")), "root")
    return named.join(roots, "uid").select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("uid") == F.col("root")).alias("kept"))


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each component (the smallest document's; the first of repeated rows), columns unchanged whatever their names."""
    ids, texts = F.col("d.doc_id").cast("long"), F.coalesce(F.col("d.text").cast("string"), F.lit(""))
    table, unique = distinct_documents(docs)
    if unique:
        chosen = near_duplicates(table.select("uid", "text"), k, percent).filter("uid = root").select("uid")
        return docs.alias("d").join(chosen.alias("c"), ids == F.col("c.uid"), "left_semi")
    table = written(table, "documents")
    roots = near_duplicates(table.dropDuplicates(["uid"]).select("uid", "text"), k, percent).filter("uid = root").select("uid")
    chosen = table.join(roots, "uid", "left_semi").select("doc_id", F.sha2("text", 256).alias("sha")).distinct()
    # the input's columns stay in one struct, so that none of their names can clash
    rows = docs.alias("d").select(F.struct("d.*").alias("row"), ids.alias("doc_id"), F.sha2(texts, 256).alias("sha")).alias("r")
    kept = rows.join(chosen.alias("c"), F.col("r.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("r.sha") == F.col("c.sha")), "left_semi")
    return kept.dropDuplicates(["doc_id", "sha"]).select("row.*")
