"""The pipeline's stages on small tables, and the registered queries against DuckDB."""

import collections
import hashlib
import math
import os
import re

import duckdb
import pytest

import corpus_pipeline
from plumbline.llm import mixing, packing, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_toxicity(rows, model):
    weight = dict(zip(model.words.tolist(), model.weights.tolist(), strict=True))
    known = {}

    def score(text):
        held = {w.translate(ASCII_LOWER) for w in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", text or "")}
        for w in held - known.keys():
            known[w] = weight.get(int(toxicity._word_hashes([w.encode()])[0][0]), 0.0)
        return sum(known[w] for w in held)

    return [r for r in rows if 1 / (1 + math.exp(min(40, max(-40, model.thresholds[0] - score(r["text"]))))) < toxicity.REJECT_AT]


def plain_near_duplicates(rows):
    sets = {}
    for r in rows:
        words = [w.translate(ASCII_LOWER) for w in WORD.findall(r["text"] or "")]
        sets[r["doc_id"]] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [r for r in rows if find(r["doc_id"]) == r["doc_id"]]


def plain_suffixes(rows):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        data = (r["text"] or "").encode()
        covered = [False] * len(data)
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                covered[p : p + 100] = [True] * 100
            seen.add(data[p : p + 100])
        kept, at, p = b"", 0, 0
        while p < len(data):
            if not covered[p]:
                p += 1
                continue
            a = p
            while p < len(data) and covered[p]:
                p += 1
            b = p
            while a < b and data[a] & 0xC0 == 0x80:
                a += 1
            while a < b < len(data) and data[b] & 0xC0 == 0x80:
                b -= 1
            kept, at = kept + data[at:a], b
        text = (kept + data[at:]).decode()
        out.append(r | {"text": text, "n_chars": len(text)})
    return out


def plain_mix(rows):
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:  # shared by weight; what a source can't take goes back to the others
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] >= 2 * sizes[s]}
        if not full:
            target |= {s: share * weight[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    out = []
    for r in rows:
        rate = target[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0.0
        told = f"{mixing.SEED}|{r['doc_id']}|{r['text'] or ''}"
        chance = int(hashlib.md5(told.encode()).hexdigest()[:13], 16) / 2**52
        out += [r] * (math.floor(rate) + (chance < rate - math.floor(rate)))
    return out


def plain_packing(rows):
    """Bins of pieces (doc_id, piece, start, n_words, source), and pieces without words."""
    number, items, alone, bins = collections.Counter(), [], [], []
    for r in rows:
        size = len(WORD.findall(r["text"] or ""))
        whole, rest = divmod(size, packing.CAPACITY)
        bins += [{"room": 0, "held": [(r["doc_id"], p, p * packing.CAPACITY, packing.CAPACITY, r["source"])], "closed": True} for p in range(whole)]
        if rest:
            items.append((-rest, r["doc_id"], number[r["doc_id"]], (r["doc_id"], whole, whole * packing.CAPACITY, rest, r["source"]), (r["text"] or "").lower()))
            number[r["doc_id"]] += 1
        elif not whole:
            alone.append((r["doc_id"], 0, 0, 0, r["source"]))
    opened = []
    for size, _, _, row, text in sorted(items, key=lambda x: x[:3]):
        fits = [b for b in opened if b["room"] >= -size and row[4] not in b["sources"] and text not in b["texts"]]
        best = min(fits, key=lambda b: b["room"]) if fits else None
        if best is None:
            best = {"room": packing.CAPACITY, "held": [], "sources": set(), "texts": set()}
            opened.append(best)
        best["room"] += size
        best["held"].append(row)
        best["sources"].add(row[4])
        best["texts"].add(text)
    told = lambda row: tuple("" if x is None else str(x) for x in row)
    return collections.Counter(tuple(sorted(map(told, b["held"]))) for b in bins + opened), collections.Counter(map(told, alone))


def test_run_against_plain_versions_of_all_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [r.asDict() for r in docs.collect()]
    assert len({r["doc_id"] for r in rows}) == len(rows)
    for stage in (lambda x: plain_toxicity(x, model), plain_near_duplicates, plain_suffixes, plain_mix):
        rows = stage(rows)
    bins, alone = plain_packing(rows)
    got, without = collections.defaultdict(list), collections.Counter()
    for r in corpus_pipeline.run(spark, sf).collect():
        told = tuple("" if x is None else str(x) for x in (r.doc_id, r.piece, r.start, r.n_words, r.source))
        if r.bin_id is None:
            without[told] += 1
        else:
            got[r.bin_id].append(told)
    assert without == alone
    assert collections.Counter(tuple(sorted(x)) for x in got.values()) == bins


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(path := str(tmp_path / name))
        if name != "best_fit_packing":
            assert sorted(out.columns) == sorted(corpus_pipeline.COLUMNS)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[2]


def test_stages_without_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


@pytest.mark.parametrize("name", ["op1_merkle_fixity", "op5_superkmers", "op6_mixing", "op8_minhash", "op10_suffixes"])
def test_against_duckdb(spark, sf, name):
    from plumbline.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    got = QUERIES[name](spark, sf)
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL[name]})").fetchall()
    show = lambda rows: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    assert show(map(tuple, got.select(*names).collect())) == show(want)
