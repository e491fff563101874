"""The training-data operators against brute force, exact round trips, held-out labels and DuckDB."""

import collections
import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pytest
import xxhash

from plumbline.llm import ctph, media, minhash, mixing, packing, suffixes, superkmers, tokenfile, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, uid string, sha string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, one id with two texts, and columns named like the operators' own."""
    rng = random.Random(5)
    words = ["w%d" % rng.randrange(4000) for _ in range(9000)]
    passage = " ".join(words[:120])
    long = " ".join(words)
    rows = [
        (1, passage, "en", "a", 1, "x", "y"), (2, "before it " + passage + " after it", "en", None, 1, None, None), (3, None, None, "b", None, None, None),
        (4, "", "en", "b", 0, None, None), (5, " \t\n ", "en", "b", 0, None, None), (6, long, "de", "a", 1, None, None), (6, long, "de", "a", 1, None, None),
        (7, "one text under an id", "en", "a", 1, None, None), (7, passage + " another text under it", "en", "a", 1, None, None),
        (None, "no id " + passage, "en", "a", 1, None, None), (8, "é" * 60 + passage, "fr", "c", 1, None, None), (9, "ü" + "é" * 60, "fr", "c", 1, None, None),
        (10, "a" * 400, "xx", "c", 1, None, None), (11, "Short Text", "en", "c", 1, None, None), (12, "short text", "en", "c", 1, None, None),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def ordered(rows):
    """Different documents in the operators' order: id (null last), then the text's hash."""
    return sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest()))


def brute_suffixes(rows):
    seen, out = set(), {}
    for i, t in ordered(rows):
        b = t.encode()
        covered = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                covered[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        spans = sum(1 for p, c in enumerate(covered) if c and not (p and covered[p - 1]))
        out[i, t] = (len(b), sum(covered), spans, hashlib.sha256(bytes(x for x, c in zip(b, covered) if not c)).hexdigest())
    return out


def brute_superkmers(rows):
    first, texts = {}, ordered(rows)
    for n, (_, t) in enumerate(texts):
        w = t.encode().split()
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), n)
    out = {}
    for n, (i, t) in enumerate(texts):
        w = t.encode().split()
        covered = bytearray(len(w))
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < n:
                covered[p : p + 13] = b"\1" * 13
        out[i, t] = (len(w), sum(covered), hashlib.sha256(b" ".join(x for x, c in zip(w, covered) if not c)).hexdigest())
    return out


@pytest.mark.parametrize("op,brute", [(suffixes, brute_suffixes), (superkmers, brute_superkmers)])
def test_substring_dedup_against_brute_force(op, brute, odd, none, documents):
    for docs in (odd, documents):
        rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
        want = brute(rows)
        got = collections.Counter(tuple(r) for r in op.cut_digests(docs).collect())
        assert got == collections.Counter((i, *want[i, t]) for i, t in rows)
    assert op.cut_digests(none).collect() == []


def test_substring_dedup_small_pieces(monkeypatch, spark, documents):
    """Texts cut into overlapping pieces, several flushes and many buckets give the same."""
    from plumbline.llm import _repeats

    monkeypatch.setattr(_repeats, "CHUNK_BYTES", 700)
    monkeypatch.setattr(_repeats, "FLUSH_BYTES", 20_000)
    monkeypatch.setattr(_repeats, "BUCKET_BYTES", 30_000)
    monkeypatch.setattr(_repeats, "RANGES", 8)
    docs = documents.filter("doc_id < 60")
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    for op, brute in ((suffixes, brute_suffixes), (superkmers, brute_superkmers)):
        want = brute(rows)
        assert {(r[0], *r[1:]) for r in op.cut_digests(docs).collect()} == {(i, *want[i, t]) for i, t in rows}


@pytest.mark.parametrize("op,brute", [(suffixes, brute_suffixes), (superkmers, brute_superkmers)])
def test_substring_dedup_of_texts_with_periods(op, brute, spark, monkeypatch):
    """Constant texts, rulers and repeated lines, alone and within others, in one piece and in several."""
    from plumbline.llm import _repeats

    line = "one line of words that comes again and again until all of the text is full of it\n"
    bodies = ["a" * 700, "a " * 900, "a b " * 300, "=-" * 400 + " " + "- " * 200, line * 40, line[:50] * 30, "x y z x y " * 90, "b" * 99, "c " * 13, "c " * 12]
    rows = [(n, t) for n, t in enumerate([*bodies, *("before it " + t + " after it" for t in bodies), *(t[5:] for t in bodies), *bodies[:4], "", "", " "])]
    want = collections.Counter((i, *x) for (i, _), x in brute(rows).items())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert collections.Counter(tuple(r) for r in op.cut_digests(docs).collect()) == want
    monkeypatch.setattr(_repeats, "CHUNK_BYTES", 300)
    monkeypatch.setattr(_repeats, "FLUSH_BYTES", 2_000)
    monkeypatch.setattr(_repeats, "BUCKET_BYTES", 2_000)
    monkeypatch.setattr(_repeats, "PARTITIONS", 3)
    assert collections.Counter(tuple(r) for r in op.cut_digests(docs).collect()) == want


_PEAK = """
import resource, sys
from plumbline.llm import suffixes, superkmers
op = {"suffixes": suffixes, "superkmers": superkmers}[sys.argv[1]]
text = sys.argv[2] * (25_000_000 // len(sys.argv[2]))
for flush in op._flushes(iter([(1, text + " end"), (2, "begin " + text)]), None):
    flush.decide()
    assert len(flush.hash) < 1000
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
"""


@pytest.mark.parametrize("op", ["suffixes", "superkmers"])
@pytest.mark.parametrize("unit", ["a", "word "])
def test_memory_of_constant_texts(op, unit):
    """25 MB of one character or one word: runs alike that follow each other aren't kept one by one."""
    out = subprocess.run([sys.executable, "-c", _PEAK, op, unit], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))})
    assert int(out.stdout) < 800  # MB


_GROWTH = """
import random, resource
from plumbline.llm import suffixes
from plumbline.llm._workers import tidied

def texts():
    rng = random.Random(1)
    for n in range(27_000):
        yield n, " ".join(f"{rng.getrandbits(20):x}" for _ in range(350))

def run(texts):
    for flush in suffixes._flushes(texts, None):
        flush.decide()
        yield len(flush.hash)
        del flush

peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
before = peak()
assert sum(tidied(run)(texts())) > 1_000_000
print(peak() - before)
"""


def test_memory_of_ordinary_texts():
    """Two flushes and a bit: pieces, parts of columns and the flush before are given up as the next is made."""
    out = subprocess.run([sys.executable, "-c", _GROWTH], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))})
    assert int(out.stdout) < 135  # MB


def test_copies_of_whole_texts_are_one_row_each(spark):
    """Whatever the number of strings in a text and of buckets, a copy costs one row of spans."""
    rng = random.Random(2)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(400)) for _ in range(3)]
    docs = spark.createDataFrame([(i, texts[i % 3]) for i in range(300)], "doc_id long, text string")
    for op in (suffixes, superkmers):
        base, _ = op.distinct_documents(docs)
        spans = op.repeat_spans(base)
        assert spans.count() == 297
        assert all(r.n_removed > 0 for r in op.cut_digests(docs).collect() if r.doc_id >= 3)


def test_deduplicated_keeps_columns_and_code_points(odd):
    out = suffixes.deduplicated(odd)
    assert out.columns == odd.columns
    rows = out.collect()
    assert len(rows) == odd.count()
    assert all(r.text is not None for r in rows)
    assert next(r for r in rows if r.doc_id == 2).text.startswith("before it ")
    assert superkmers.deduplicated(odd).count() == odd.count()


def test_loser_tree_merges_and_shares():
    rng = np.random.default_rng(3)
    runs, keys = [], []
    for n in (0, 1, 50, 200, 7):
        k = rng.integers(97, 99, (n, suffixes.DEPTH)).astype(np.uint8)
        k = k[np.lexsort(k.T[::-1])] if n else k
        shared, tails = suffixes.encode_run(k)
        assert (suffixes.decode_run(shared, tails) == k).all()
        runs.append((shared.tolist(), [x.tolist() for x in suffixes._words(k)]))
        keys.append([x.tobytes() for x in k])
    got = [(keys[r][i], share) for r, i, share in suffixes.merge_runs(runs)]
    assert [k for k, _ in got] == sorted(x for k in keys for x in k)
    for (a, _), (b, share) in zip(got, got[1:]):
        assert share == len(os.path.commonprefix([a, b]))


def brute_components(rows, k, percent):
    texts = ordered(rows)
    sets = []
    for _, t in texts:
        w = t.encode().lower().split()
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {texts[n]: (len(sets[n]), texts[find(n)][0], find(n) == n) for n in range(len(texts))}


def test_minhash_against_brute_force(odd, none, documents):
    for docs, k, percent in ((odd, 3, 85), (documents, 3, 85), (documents, 5, 80)):
        rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
        want = brute_components(rows, k, percent)
        got = collections.Counter(tuple(r) for r in minhash.near_duplicate_components(docs, k, percent).collect())
        assert got == collections.Counter((i, *want[i, t]) for i, t in rows)
    assert minhash.near_duplicate_components(none).collect() == []


def test_minhash_large_group_of_near_copies(spark):
    """Independent edits of one text: the rounds meet what the smallest document alone would miss."""
    rng = random.Random(11)
    base = ["b%d" % rng.randrange(10**6) for _ in range(200)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(200)] = "e%d" % rng.randrange(10**9)
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicate_components(docs, 3, 85).collect()}
    assert got == {i: want[i, t] for i, t in rows}


def test_without_near_duplicates(odd, documents):
    for docs in (odd, documents):
        rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
        want = {key for key, (_, _, kept) in brute_components(rows, 5, 80).items() if kept}
        out = minhash.without_near_duplicates(docs)
        assert out.columns == docs.columns
        assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect()) == sorted((i is None, i or 0, t) for i, t in want)


def test_least_matches():
    n, p = minhash.COORDINATES, 0.85
    needed = minhash.least_matches(85)
    rng = np.random.default_rng(1)
    assert (rng.binomial(n, p, 200_000) < needed).sum() <= 3
    assert minhash.least_matches(100) == n


def test_png_round_trip_and_filters():
    rng = np.random.default_rng(0)
    for n in (64, 640, 64 * 3000):
        data = rng.integers(0, 256, n).astype(np.uint8).tobytes()
        assert media.decode_png(media.encode_png(data)).tobytes() == data
    image = rng.integers(0, 256, (9, 64)).astype(np.uint8)
    kinds = np.array([4, 3, 2, 2, 1, 0, 3, 4, 1], np.uint8)
    lines = np.empty((9, 65), np.uint8)
    lines[:, 0] = kinds
    for y in range(9):
        for x in range(64):
            a, b, c = (int(image[y, x - 1]) if x else 0), (int(image[y - 1, x]) if y else 0), (int(image[y - 1, x - 1]) if x and y else 0)
            p = a + b - c
            paeth = min((a, b, c), key=lambda v: abs(p - v))
            lines[y, x + 1] = (int(image[y, x]) - (0, a, b, (a + b) // 2, paeth)[kinds[y]]) % 256
    assert (media.unfilter(lines[:, 0], lines[:, 1:]) == image).all()


def test_png_damage_is_found():
    good = media.encode_png(bytes(range(64)) * 20)
    for at in range(8, len(good)):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(media.PngError):
            media.decode_png(bytes(bad))
    with pytest.raises(media.PngError):
        media.decode_png(good[:-5])


def test_media_contract(odd, none):
    rows = media.media_features(media.to_media(odd)).collect()
    texts = sorted((r.text or "").encode() for r in odd.collect())
    assert sorted(r.n_bytes for r in rows) == sorted(map(len, texts))
    by = {hashlib.sha256(t.ljust(max(64, -(-len(t) // 64) * 64), b"\0")).hexdigest(): t for t in texts}
    features = collections.defaultdict(set)
    for r in rows:
        data = by[r.payload_sha256]
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(data), len(padded), zlib.crc32(padded[-64:]))
        features[r.payload_sha256].add((r.feature, r.media_sha256, r.media_bytes))
    assert all(len(x) == 1 for x in features.values())
    assert media.media_features(media.to_media(none)).collect() == []


def test_cosine_hash_is_stable():
    image = np.add.outer(np.arange(96), np.arange(64)).astype(np.uint8)
    brighter = np.clip(image.astype(int) + 2, 0, 255).astype(np.uint8)
    far = bin(int(media.cosine_hash(image), 16) ^ int(media.cosine_hash(brighter), 16)).count("1")
    assert far <= 6


def levenshtein_without_substitution(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


def test_ctph(odd, none):
    rng = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(70))) for _ in range(2))
        assert ctph.indel_distance(a, b) == levenshtein_without_substitution(a, b)
    text = " ".join("t%d" % rng.randrange(10**6) for _ in range(2000))
    changed = text[:5000] + " an insertion " + text[5000:]
    other = " ".join("o%d" % rng.randrange(10**6) for _ in range(2000))
    mark = ctph.fingerprint(text.encode())
    assert ctph.likeness(mark, ctph.fingerprint(changed.encode())) > 0.8
    assert ctph.likeness(mark, ctph.fingerprint(other.encode())) < 0.4
    assert ctph.fingerprint(b"") == "3::"

    rows = ctph.fingerprint_documents(odd).collect()
    assert len(rows) == odd.count()
    assert ctph.fingerprint_documents(none).collect() == []


def test_ctph_neighbours(spark, documents):
    texts = sorted((r.doc_id, r.text or "") for r in documents.select("doc_id", "text").collect())
    want = {}
    for n, (i, t) in enumerate(texts):
        after = texts[(n + 1) % len(texts)][1]
        half = len(t) // 2
        changed = t[: len(t) - half] + after[:half]
        a, b, c = (ctph.fingerprint(x.encode()) for x in (t, changed, after))
        want[i] = (len(t), hashlib.sha256(changed.encode()).hexdigest(), a, b, ctph.likeness(a, b), ctph.likeness(a, c))
    for frame in (documents, documents.repartition(5), documents.coalesce(1)):
        assert {r.doc_id: tuple(r)[1:] for r in ctph.fingerprint_documents(frame).collect()} == want
    lone = spark.createDataFrame([(1, "alone here")], "doc_id long, text string")
    assert ctph.fingerprint_documents(lone).first().near_next == 1.0


def test_token_counts(odd, none, documents):
    enc = tokenfile.encoder(f"{tokenfile.TOKENIZERS}/byte_bpe_50k.tiktoken")
    for docs in (odd, documents):
        want = collections.Counter((r.doc_id, len(enc.encode_ordinary(r.text or ""))) for r in docs.collect())
        assert collections.Counter((r.doc_id, r.n_tokens) for r in tokenfile.count_document_tokens(docs).collect()) == want
    assert tokenfile.count_document_tokens(none).collect() == []


def _token_documents(tokens, eod):
    want, start = [], 0
    for end in np.flatnonzero(tokens == eod).tolist():
        want.append((len(want), start, end - start, True))
        start = end + 1
    return want + [(len(want), start, len(tokens) - start, False)] * (start < len(tokens))


def _told(df):
    return [(r.ordinal, r.token_start, r.n_tokens, r.closed) for r in df.orderBy("ordinal").collect()]


@pytest.mark.parametrize("eod,kind", [(tokenfile.EOD, "<u2"), (0, "<u2"), (0x4141, "<u2"), (100_257, "<u4"), (0, "<u4"), (0x41414141, "<u4")])
def test_scan_of_flat_files(spark, tmp_path, eod, kind):
    """Splits and blocks that end within tokens, identifiers that overlap themselves, files with and without an unclosed end."""
    rng = np.random.default_rng(4)
    width = int(kind[-1])
    tokens = np.where(rng.random(3000) < 0.02, eod, rng.integers(0, 50_000, 3000)).astype(kind)
    if eod == 0x4141 or eod == 0x41414141:  # single bytes of it all over
        tokens[rng.random(3000) < 0.3] = 0x41 << 8 * (width - 1)
        tokens[rng.random(3000) < 0.3] = 0x41
    tokens[[0, 1, 63, 64, 127, 128]] = eod
    for k, tail in enumerate((tokens, np.append(tokens, np.array([eod], kind)), np.append(tokens, np.array([5, 5], kind)), np.append(tokens, np.array([0xC4], kind)))):
        where = tmp_path / str(k)
        where.mkdir()
        (where / "flat.bin").write_bytes(tail.tobytes())
        want = _token_documents(tail, eod)
        blocks = lambda n, data=tail.tobytes(): [("s", i, data[at : at + n]) for i, at in enumerate(range(0, len(data), n))]
        for n in (1, 7, 1001)[k % 3 : k % 3 + 1]:
            assert _told(tokenfile.scan(spark.createDataFrame([*blocks(n), ("s", 10**6, None)], "shard string, block_no long, payload binary").repartition(3), eod, width)) == want
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        try:
            for block in (1, 1 << 20)[k % 2 :]:
                assert _told(tokenfile.scan_files(spark, str(where), eod, width, block)) == want
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_flat_files_hold_tokens_alone(spark, odd, tmp_path):
    """What is written are flat files of identifiers; ids lie beside them in the same order, splits or not."""
    path = str(tmp_path / "t")
    tokenfile.write_token_files(odd.repartition(2, "text"), path)
    enc = tokenfile.encoder(f"{tokenfile.TOKENIZERS}/byte_bpe_50k.tiktoken")
    texts = collections.Counter(tuple(enc.encode_ordinary(r.text or "")) for r in odd.collect())
    found = collections.Counter()
    for f in (tmp_path / "t").glob("kind=tokens/shard=*/part-*"):
        tokens = np.frombuffer(f.read_bytes(), "<u2")
        assert tokens[-1] == tokenfile.EOD
        for _, at, n, _ in _token_documents(tokens, tokenfile.EOD):
            found[tuple(tokens[at : at + n].tolist())] += 1
    assert found == texts
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10")
    try:
        ids = tokenfile.read_ids(spark, f"{path}/kind=ids").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert collections.Counter(r.doc_id for r in ids) == collections.Counter(r.doc_id for r in odd.collect())
    assert len({(r.shard, r.ordinal) for r in ids}) == len(ids)


def test_long_text_tokens_like_whole():
    enc = tokenfile.encoder(f"{tokenfile.TOKENIZERS}/byte_bpe_50k.tiktoken")
    rng = random.Random(8)
    text = "".join(rng.choice(["word", " ", "  ", "\n", "It's", "12", "é", "!?", " x"]) for _ in range(120_000))
    assert tokenfile.encode_text(enc, text) == enc.encode_ordinary(text)


def water_level(sizes, weights, factor, most):
    targets, free = {}, set(sizes)
    rest = factor * sum(sizes.values())
    while free:
        share = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return targets | share
        targets |= {s: most * sizes[s] for s in over}
        rest -= sum(most * sizes[s] for s in over)
        free -= over
    return targets


def test_mixing(odd, none, documents):
    for docs in (odd, documents):
        rows = docs.collect()
        sizes = collections.defaultdict(int)
        for r in rows:
            sizes[r.source] += len((r.text or "").encode().split())
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        want = water_level(dict(sizes), {s: mixing.WEIGHTS[n % 3] for n, s in enumerate(order)}, 1.5, 2.0)
        got = mixing.mix(docs).collect()
        assert len(got) == len(rows)
        by_size = {(s, round(want[s], 4)) for s in sizes}
        assert {round(r.target, 4) for r in got} <= {t for _, t in by_size}
        assert all(r.taken <= 2 * r.size for r in got)
        assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
        copies = mixing.mixed(docs)
        assert copies.columns == docs.columns
        assert copies.count() == sum(r.copies for r in got if r.size)
    assert mixing.mix(none).collect() == []


def test_mixing_keeps_rows_without_words(spark):
    rows = [(i, "some words here", "a") for i in range(40)] + [(100 + i, t, "a") for i, t in enumerate((None, "", " \n ") * 10)] + [(200, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    got = collections.Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert got == want and any(100 <= i < 200 for i in got) and 200 not in got


def test_mixing_many_sources(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randrange(1, 40)), "s%04d" % rng.randrange(3000)) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = water_level(dict(sizes), {s: mixing.WEIGHTS[n % 3] for n, s in enumerate(sorted(sizes))}, 1.5, 2.0)
    sized = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sized).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)
    assert docs.count() == 6000


def brute_best_fit(items, capacity):
    bins, out = [], []  # room, sources, clusters
    for size, source, cluster in items:
        fits = [(b[0], n) for n, b in enumerate(bins) if b[0] >= size and source not in b[1] and (cluster is None or cluster not in b[2])]
        n = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([capacity, set(), set()])
        bins[n][0] -= size
        bins[n][1].add(source)
        bins[n][2].add(cluster)
        out.append(n)
    return out


def test_pack_shard_against_brute_force():
    rng = random.Random(6)
    for _ in range(40):
        capacity = rng.choice([10, 64, 100])
        items = [(rng.randrange(1, capacity + 1), rng.randrange(6), rng.choice([None, 1, 2, 3])) for _ in range(150)]
        items.sort(key=lambda x: -x[0])
        assert packing.pack_shard(items, capacity) == brute_best_fit(items, capacity)


def test_packing_whole(odd, none, documents):
    for docs, capacity in ((odd, 100), (documents, 2048)):
        rows = packing.pack_documents(docs, capacity, 50).collect()
        sizes = collections.Counter()
        for r in docs.collect():
            sizes[r.doc_id] += len((r.text or "").encode().split())
        got = collections.Counter()
        bins = collections.defaultdict(list)
        for r in rows:
            got[r.doc_id] += r.n_words
            assert (r.bin_id is None) == (r.n_words == 0)
            bins[r.bin_id].append(r)
        bins.pop(None, None)
        assert got == sizes
        assert all(sum(r.n_words for r in b) <= capacity for b in bins.values())
        assert all(len({r.source for r in b}) == len(b) for b in bins.values())
    assert packing.pack_documents(none).collect() == []


def test_packing_keeps_near_copies_apart(spark, odd, none):
    rng = random.Random(8)
    rows = []
    for i in range(30):
        words = ["w%d" % rng.randrange(10**6) for _ in range(60)]
        rows.append((2 * i, " ".join(words), f"s{2 * i}"))
        words[-1] = "other"
        rows.append((2 * i + 1, "\n".join(words).upper(), f"s{2 * i + 1}"))
    docs = spark.createDataFrame([*rows, (60, None, "s0")], "doc_id long, text string, source string")
    got = {r.doc_id: r.bin_id for r in packing.pack_apart(docs, capacity=120).collect()}
    assert len(got) == 61 and got[60] is None
    assert all(got[2 * i] != got[2 * i + 1] for i in range(30))
    count = lambda f: collections.Counter((r.doc_id, r.piece, r.start, r.n_words, r.source) for r in f(odd, capacity=100).collect())
    assert count(packing.pack_apart) == count(packing.pack_documents)
    assert packing.pack_apart(none).collect() == []


def test_packing_query_keeps_near_copies_apart(spark, tmp_path):
    from plumbline.llm.queries import QUERIES

    words = ["w%d" % i for i in range(60)]
    rows = [(1, " ".join(words), "a"), (2, " ".join([*words[:-1], "other"]), "b"), (3, "\t".join(words), "c")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert len({r.bin_id for r in QUERIES["op3_best_fit_packing"](spark, str(tmp_path)).collect()}) == 3


def test_merkle_audit(spark, none):
    pages = [(i, f"http://h/{i}", "x" * (i % 50)) for i in range(700)] + [(None, None, None), (3, "http://h/3", "xxx")]
    slots = warc.archive(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert sorted(r.position for r in slots.collect()) == list(range(702))
    records = [(r.position, f"{r.url}|{r.html}") for r in slots.collect()]
    first = spark.createDataFrame(records, "position long, record string")
    changed = [(p, t + "!" if p in (5, 300) else t[::-1] if p == 301 else t) for p, t in records if p != 17] + [(702, "new")]
    second = spark.createDataFrame(changed, "position long, record string")
    assert {(r.position, r.status) for r in warc.audit(first, second).collect()} == {(5, "corrupt"), (300, "corrupt"), (301, "corrupt"), (17, "missing"), (702, "extra")}
    assert warc.audit(first, first).collect() == []
    empty = spark.createDataFrame([], "page_id long, url string, html string, position long")
    assert warc.audited_pages(empty).collect() == []


def test_merkle_descends_only_where_nodes_differ(spark):
    records = spark.createDataFrame([(i, f"r{i}") for i in range(4096)], "position long, record string")
    other = spark.createDataFrame([(i, f"r{i}" if i != 1000 else "bad") for i in range(4096)], "position long, record string")
    a, b = warc.tree(records, 3), warc.tree(other, 3)
    for level, (x, y) in enumerate(zip(a, b)):
        assert x.exceptAll(y).count() == 1, level


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = labels.filter("doc_id % 3 = 0")
    model = toxicity.train(docs, labels.filter("doc_id % 3 <> 0"))
    assert list(model.thresholds) == sorted(model.thresholds)
    rows = docs.join(held, "doc_id").select("text", "toxic").collect()
    p = toxicity.score_texts(model, [r.text for r in rows])
    toxic = np.array([r.toxic for r in rows]) == 1
    caught = p[:, 0] >= toxicity.REJECT_AT
    assert (caught & toxic).sum() / toxic.sum() > 0.75
    assert (caught & ~toxic).sum() / (~toxic).sum() < 0.005
    assert (np.diff(p, axis=1) <= 1e-12).all()


def test_toxicity_odd_inputs(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (2, 0, 0), (None, 1, 1), (4, 1, None), (99, 0, 1)], "doc_id long, quality int, toxic int")
    for docs in (odd, none):
        for given in (labels, labels.limit(0)):
            rows = toxicity.score(docs, given).collect()
            assert len(rows) == docs.count()
            assert all(0 <= r.expected_severity <= toxicity.GRADES - 1 for r in rows)
    assert toxicity.reject_toxic(odd, labels.limit(0)).count() == odd.count()
    assert toxicity.reject_toxic(odd, labels).columns == odd.columns


def test_ordinal_fit_recovers_order():
    rng = np.random.default_rng(9)
    n, w = 4000, np.array([2.0, -1.5, 0.5, 0.0])
    x = rng.random((n, 4)) < 0.5
    eta = x @ w + rng.logistic(size=n)
    grades = np.digitize(eta, [0.0, 1.5, 3.0])
    rows, columns = np.nonzero(x)
    got, thresholds = toxicity.fit_ordinal(rows, columns, grades, 4, 4, l2=1e-6, steps=1500)
    assert np.abs(got - w).max() < 0.3
    assert np.abs(thresholds - [0.0, 1.5, 3.0]).max() < 0.3


def test_shingles_of_long_texts_in_pieces(monkeypatch):
    rng = random.Random(12)
    texts = [" ".join("W%d" % rng.randrange(300) for _ in range(n)) for n in (1, 2, 3, 50, 4000)] + ["", None, " \n ", "x" * 5000, "é " * 900]
    for k in (1, 3, 5):
        want = minhash.shingle_sets(texts, k)
        for chunk in (40, 1000):
            monkeypatch.setattr(minhash, "_CHUNK", chunk)
            got = minhash.shingle_sets(texts, k)
            assert all((a == b).all() and len(a) == len(b) for a, b in zip(want, got, strict=True)), (k, chunk)
        monkeypatch.undo()


def test_shingles_of_long_words_in_pieces(monkeypatch):
    w = "W" * 100
    texts = [w + " a b c", w + " x", w + " y", w, f"{w} {w} z", f" {w} {w}", f"a {w} b {w} c d"]
    want = minhash.shingle_sets(texts, 3)
    assert [len(x) for x in want] == [2, 1, 1, 1, 1, 1, 4]
    for chunk in (40, 150):
        monkeypatch.setattr(minhash, "_CHUNK", chunk)
        got = minhash.shingle_sets(texts, 3)
        assert [x.tolist() for x in got] == [x.tolist() for x in want], chunk


def test_toxicity_long_texts_in_pieces(monkeypatch):
    words = toxicity._word_hashes([b"idiot scum"])[0]
    model = toxicity.OrdinalModel(np.sort(words), np.array([2.0, 3.0]), np.array([1.0, 2.0, 3.0]))
    texts = ["so " * 400 + "idiot " + "so " * 400 + "Scum!", "", None, "y" * 3000]
    want = toxicity.score_texts(model, texts)
    monkeypatch.setattr(toxicity, "_CHUNK", 100)
    assert np.allclose(toxicity.score_texts(model, texts), want)
    assert want[0, 0] > 0.9 > want[1, 0]


def test_cosine_hash_against_plain_sums():
    """The low-frequency corner by the cosine transform's definition, cell by cell."""
    rng = random.Random(8)
    for height in (1, 5, 31, 32, 33, 100):
        image = np.array([[rng.randrange(256) for _ in range(64)] for _ in range(height)], np.uint8)
        n, low = media.CELLS, media.LOW

        def bounds(size, i):
            return (i * size // n, (i + 1) * size // n) if size >= n else (i * size // n, i * size // n + 1)

        cells = [[0.0] * n for _ in range(n)]
        for i in range(n):
            for j in range(n):
                (a, b), (c, d) = bounds(height, i), bounds(64, j)
                cells[i][j] = sum(int(image[y, x]) for y in range(a, b) for x in range(c, d)) / ((b - a) * (d - c))
        cos = [[math.cos(math.pi * (2 * x + 1) * k / (2 * n)) for x in range(n)] for k in range(low)]
        corner = [round(sum(cells[y][x] * cos[u][y] * cos[v][x] for y in range(n) for x in range(n)), 6) for u in range(low) for v in range(low)]
        median = sorted(corner[1:])[len(corner[1:]) // 2]
        bits = "".join("1" if x > median else "0" for x in corner)
        assert media.cosine_hash(image) == f"{int(bits, 2):016x}"


def plain_fingerprint(data):
    if not data:
        return "3::"
    rolls = []
    for i in range(len(data)):
        last = [data[i - k] if i >= k else 0 for k in range(7)]  # the newest first
        shifted = 0
        for k, x in enumerate(last):
            shifted ^= (x << (5 * k)) & 0xFFFFFFFF
        rolls.append((sum(last) + sum(x * (7 - k) for k, x in enumerate(last)) + shifted) & 0xFFFFFFFF)

    def letters(block, most):
        cuts = [i + 1 for i, r in enumerate(rolls) if r % block == block - 1][: most - 1]
        edges = [0, *cuts] + [len(data)] * (not cuts or cuts[-1] < len(data))
        return "".join(chr(ctph.LETTERS[xxhash.xxh64(data[a:b]).intdigest() % 64]) for a, b in zip(edges[:-1], edges[1:], strict=True))

    block = 3
    while block * 64 < len(data):
        block *= 2
    while block > 3 and len(letters(block, 64)) < 32:
        block //= 2
    return f"{block}:{letters(block, 64)}:{letters(2 * block, 32)}"


def test_fingerprint_against_plain_rolling_hash(monkeypatch):
    rng = random.Random(6)
    texts = [b"", b"a", b"abcdefg", b"a" * 500, bytes(rng.randrange(256) for _ in range(3000)), b"\xff" * 100, *(("".join(rng.choice("abcde \n") for _ in range(n))).encode() for n in (8, 100, 700, 4000, 20_000))]
    want = [plain_fingerprint(x) for x in texts]
    assert [ctph.fingerprint(x) for x in texts] == want
    monkeypatch.setattr(ctph, "CHUNK_BYTES", 97)
    assert [ctph.fingerprint(x) for x in texts] == want


_PEAK_CTPH = """
import resource
from plumbline.llm import ctph
for unit in (b"a", b"some words of a text "):
    ctph.fingerprint(unit * (40_000_000 // len(unit)))
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
"""


def test_memory_of_fingerprints():
    """40 MB of text are hashed chunk by chunk."""
    out = subprocess.run([sys.executable, "-c", _PEAK_CTPH], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))})
    assert int(out.stdout) < 300  # MB


def test_scores_against_plain_sums():
    """Expected severity from the definition: a sigmoid of threshold less the sum of the weights of the words that a text holds."""
    rng = random.Random(9)
    known = ["idiot", "scum", "été", "x1", "zebra"]
    weights = dict(zip(known, (2.0, 3.0, -1.0, 0.5, 1.5), strict=True))
    hashes = toxicity._word_hashes([" ".join(known).encode()])[0]
    order = np.argsort(hashes)
    model = toxicity.OrdinalModel(hashes[order], np.array([weights[known[i]] for i in order]), np.array([1.0, 2.5, 4.0]))
    texts = ["", "Idiot, idiot! SCUM", "ÉTÉ été x1x1 x1", *(" ".join(rng.choice([*known, "other", "words", "Zebra-x1"]) for _ in range(rng.randrange(30))) for _ in range(40))]
    for text, p in zip(texts, toxicity.score_texts(model, texts), strict=True):
        held = {w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", text)}
        score = sum(weights.get(w, 0.0) for w in held)
        assert np.allclose(p, [1 / (1 + math.exp(t - score)) for t in (1.0, 2.5, 4.0)], atol=1e-12)


def test_minhash_of_very_long_words(spark):
    """A word longer than a piece is one word; words that a polynomial hash confuses are two."""
    thue, other = [0], [1]
    while len(thue) < 4096:
        thue, other = thue + other, other + thue
    t, u = ("".join("ab"[b] for b in x) for x in (thue, other))
    rows = [(1, "a" * 600_000 + " b c d"), (2, f"{t} x y z"), (3, f"{u} x y z"), (4, "w" * 600_000 + " x"), (5, "w" * 600_000 + " y"), (6, "w" * 600_000 + " x"), (7, "p q " + "v" * 700_000 + " r s " + "v" * 700_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {1: (2, 1), 2: (2, 2), 3: (2, 3), 4: (1, 4), 5: (1, 5), 6: (1, 4), 7: (4, 7)}


CLASHING = ["uid", "sha", "_id", "_sha", "_s", "_uid", "_c0", "_copies", "_copy", "_rate", "_source", "_chance", "row", "rate", "chance", "copies", "packed", "spans", "start", "end", "starts", "ends", "first", "n", "root", "rep", "source_size", "target", "place", "tie", "part"]


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents whose other columns are named as the operators' own."""
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, "a"), (2, "before " + words, "b"), (2, "other text under an id", "b"), (None, None, None), (3, words, "a"), (3, words, "a")]
    names = "doc_id long, text string, source string, lang string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame([(i, t, s, "en", 1, *(f"{c}{k}" for c in CLASHING)) for k, (i, t, s) in enumerate(rows)], names)


def test_clashing_columns(spark, clashing):
    """Operators that keep the input's columns keep these as they are; the others take no notice of them."""
    given = {tuple(r[c] for c in CLASHING): r for r in clashing.collect()}
    plain = clashing.select("doc_id", "text", "source", "lang", "n_chars")
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    keepers = {
        "mixed": mixing.mixed, "minhash": minhash.without_near_duplicates, "toxicity": lambda d: toxicity.reject_toxic(d, labels), "suffixes": suffixes.deduplicated, "superkmers": superkmers.deduplicated,
    }
    for name, keep in keepers.items():
        out = keep(clashing)
        assert out.columns == clashing.columns, name
        rows = out.collect()
        assert rows and all(given[tuple(r[c] for c in CLASHING)].doc_id == r.doc_id for r in rows), name
        assert collections.Counter((r.doc_id, r.text) for r in rows) == collections.Counter((r.doc_id, r.text) for r in keep(plain).collect()), name
    for name, run in {
        "mix": mixing.mix, "op8": minhash.near_duplicate_components, "op5": superkmers.cut_digests, "op10": suffixes.cut_digests, "op9": ctph.fingerprint_documents, "op2": lambda d: media.media_features(media.to_media(d)),
        "op4": lambda d: toxicity.score(d, labels), "op7": lambda d: tokenfile.count_document_tokens(d).drop("shard", "ordinal", "token_start"),
    }.items():
        assert collections.Counter(map(tuple, run(clashing).collect())) == collections.Counter(map(tuple, run(plain).collect())), name
    assert packing.pack_documents(clashing).count() == packing.pack_apart(clashing).count() == clashing.count()


@pytest.mark.parametrize("kind", ["long", "binary"])
def test_join_of_hot_keys(spark, monkeypatch, kind):
    """Hot keys by a broadcast, the others by a shuffle: as a plain join, null keys and keys of one side left out."""
    from pyspark.sql import functions as F

    from plumbline.llm import _common

    rng = random.Random(3)
    rows = spark.createDataFrame([(rng.choice([1, 1, 1, 2, 3, 4, 5, None]), i) for i in range(400)], "k long, i int").withColumn("k", F.col("k").cast("string").cast(kind) if kind == "binary" else F.col("k"))
    keyed = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("top")).filter("n <> 0 AND k IS NOT NULL")
    some = keyed.filter(F.col("top") % 2 == 0)
    for given in (keyed, some):
        want = sorted(map(str, rows.join(given, "k").select("k", "i", "n", "top").collect()))
        for hot in (1, 60, 10**6):
            monkeypatch.setattr(_common, "HOT_ROWS", hot)
            assert sorted(map(str, _common.join_keys(rows, given, "k", 400).select("k", "i", "n", "top").collect())) == want
