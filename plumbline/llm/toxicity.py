"""Toxicity: severity grades by cumulative-link ordinal regression on sparse words.

P(grade <= k | x) = sigmoid(threshold_k - w . x): one weight vector for all thresholds, which are kept in order as sums of
exponentials. x marks which words of the vocabulary a text holds; the vocabulary is the words that at least `least_docs`
training documents hold and whose holders' grades differ from the mean by `least_z` standard errors or more (the score
test of a single weight; labels are noisy, and rare words would learn the noise by heart), at most `max_features` of
them, the surest first. Near copies among the training documents count once. Words are runs of
ASCII letters and digits and of non-ASCII characters, A-Z lower-cased; they are told apart by 64-bit hashes.

The model is fitted on the driver from at most `max_train` labelled documents, those with the smallest hashes of their id;
it is then sent to every task (at most `max_features` words of 16 bytes). Scoring reads every whole text.

Grades: labels say toxic or not. A fit with the one threshold between these orders the toxic training documents by their
evidence; their thirds are the grades 1 (mild), 2 and 3 (severe), 0 is not toxic. The model of all thresholds is fitted to
these grades.

Defined results: null and empty texts hold no words and get the thresholds' own grades; repeated rows get equal scores;
of several labels for one id the greatest counts; labels without a document, or null in id or `toxic`, are left out; without
labels of two grades at least (an empty table), or words that tell them apart, the model says grade 0 for all. Other columns are ignored or, by
`reject_toxic`, kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import _kernels as K
from plumbline.llm._workers import give_back, tidied

MAX_TRAIN = 8_000
MAX_FEATURES = 1 << 17
LEAST_DOCS = 5
LEAST_Z = 4.0
GRADES = 4
REJECT_AT = 0.5
_CHUNK = 1 << 19


@dataclass(frozen=True)
class OrdinalModel:
    words: np.ndarray  # sorted 64-bit hashes
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, GRADES - 1 of them

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2) ... as columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))


def _word_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the place of each word's text among the parts."""
    buf, _, starts = K.joined(parts)
    buf = K.LOWER[buf]
    a, b = K.word_bounds(buf, K.WORD_BYTES)
    return K.slice_hash(K.prefix_hash(buf), a, b), np.searchsorted(starts, a, "right") - 1


def _pieces(texts: list[str]) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the texts; long ones in pieces cut at a space, since words alone count."""
    for i, text in enumerate(texts):
        data = (text or "").encode()
        at = 0
        while len(data) - at > _CHUNK:
            cut = data.rfind(b" ", at, at + _CHUNK)
            cut = cut if cut > at else next((j for j in range(at + _CHUNK, len(data)) if not K.WORD_BYTES[data[j]]), len(data))
            yield i, data[at:cut]
            at = cut
        yield i, data[at:]


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, n_features: int, n_grades: int = GRADES, l2: float = 3e-5, steps: int = 600, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from the non-zero places (rows, columns) of 0/1 features, by full-batch AdaGrad on the mean log loss.

    Step k's gradient uses d log P(grade) / d eta with eta = w . x, P(grade = g) = s(t_g - eta) - s(t_{g-1} - eta).
    """
    n = len(grades)
    w = np.zeros(n_features)
    share = np.array([(grades <= k).mean() for k in range(n_grades - 1)]).clip(1e-4, 1 - 1e-4)
    at = np.log(share / (1 - share))
    first, gaps = at[0], np.log(np.maximum(np.diff(at), 1e-2))
    seen = np.zeros(n_features) + 1e-8
    seen_t = np.zeros(n_grades - 1) + 1e-8
    for _ in range(steps):
        t = first + np.concatenate(([0], np.cumsum(np.exp(gaps))))
        eta = np.bincount(rows, w[columns], n)
        low = np.concatenate(([-np.inf], t))[grades] - eta
        high = np.concatenate((t, [np.inf]))[grades] - eta
        s_low, s_high = 1 / (1 + np.exp(-np.clip(low, -40, 40))), 1 / (1 + np.exp(-np.clip(high, -40, 40)))
        s_low[grades == 0], s_high[grades == n_grades - 1] = 0, 1
        p = np.maximum(s_high - s_low, 1e-12)
        d_high, d_low = s_high * (1 - s_high) / p, s_low * (1 - s_low) / p
        g_eta = (d_high - d_low) / n  # gradient of the loss
        g_w = np.bincount(columns, g_eta[rows], n_features) + l2 * w
        g_t = np.array([-(d_high[grades == k].sum() - d_low[grades == k + 1].sum()) / n for k in range(n_grades - 1)])
        steps_t = np.concatenate(([g_t.sum()], [g_t[k:].sum() * np.exp(gaps[k - 1]) for k in range(1, n_grades - 1)]))
        seen += g_w**2
        seen_t += steps_t**2
        w -= rate * g_w / np.sqrt(seen)
        move = rate * steps_t / np.sqrt(seen_t)
        first -= move[0]
        gaps = np.clip(gaps - move[1:], -6, 6)
    return w, first + np.concatenate(([0], np.cumsum(np.exp(gaps))))


def _without_copies(values: np.ndarray, offsets: np.ndarray, bands: int = 4, width: int = 4) -> np.ndarray:
    """Which documents stay if near copies count once: those that share no band of minima of word hashes with an earlier one.

    Copies tend to carry one label; each counted, their rare words would look like sure signs.
    """
    minima = np.zeros((len(offsets) - 1, bands * width), np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    for i in range(bands * width):
        if len(full):
            minima[full, i] = np.minimum.reduceat(K.mix64(values ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) % (1 << 64))), offsets[full])
    seen: list[set] = [set() for _ in range(bands)]
    stays = np.ones(len(minima), bool)
    for d, row in enumerate(minima.reshape(len(minima), bands, width)):
        keys = [x.tobytes() for x in row]
        stays[d] = not any(k in s for k, s in zip(keys, seen, strict=True))
        for k, s in zip(keys, seen, strict=True):
            s.add(k)
    return stays


def train(docs: DataFrame, labels: DataFrame, **bounds) -> OrdinalModel:
    """The model of `_trained`; the driver keeps nothing else."""
    try:
        return _trained(docs, labels, **bounds)
    finally:
        give_back()


def _trained(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_features: int = MAX_FEATURES, least_docs: int = LEAST_DOCS, least_z: float = LEAST_Z) -> OrdinalModel:
    none = OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.arange(40.0, 40 + GRADES - 1))
    grade = F.when(F.col("toxic") == 0, 0).otherwise(1)
    graded = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(grade).alias("_grade"))
    sample = graded.orderBy(F.xxhash64("_id"), "_id").limit(max_train)  # a bound of the operator: see max_train
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    chosen = texts.join(F.broadcast(sample), F.col("_doc") == F.col("_id")).select("_doc", "_grade", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            words: list[list[np.ndarray]] = [[] for _ in texts]
            for i, data in _pieces(texts):
                words[i].append(np.unique(_word_hashes([data])[0]))
            sets = [np.unique(np.concatenate(x)).view(np.int64) for x in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["doc", "grade", "words"])

    table = chosen.mapInArrow(tidied(run), "doc long, grade int, words array<long>").toArrow()
    table = table.take(pc.sort_indices(table, [("doc", "ascending")]))  # fits don't depend on the order of tasks
    grades = table["grade"].to_numpy().astype(np.int64)
    if len(np.unique(grades)) < 2:
        return none
    lists = table["words"].combine_chunks()
    values, offsets = lists.values.to_numpy().view(np.uint64), lists.offsets.to_numpy()
    del table
    values, offsets = values[offsets[0] : offsets[-1]], offsets - offsets[0]
    single = _without_copies(values, offsets)
    stays = np.repeat(single, np.diff(offsets))
    values, grades = values[stays], grades[single]
    rows = np.repeat(np.arange(len(grades), dtype=np.int32), np.diff(offsets)[single])
    del lists, stays
    if len(np.unique(grades)) < 2:
        return none
    vocabulary, held = np.unique(values, return_counts=True)
    place = np.searchsorted(vocabulary, values).astype(np.int32)
    # the sum of the grades of a word's holders against a draw of as many documents without replacement
    total, n = np.bincount(place, grades[rows]), len(grades)
    spread = grades.var() * held * (n - held) / max(1, n - 1)
    z = np.abs(total - held * grades.mean()) / np.sqrt(np.maximum(spread, 1e-12))
    good = (held >= min(least_docs, max(1, n // 50))) & (held < n) & (z >= least_z)
    if good.sum() > max_features:
        good[np.lexsort((vocabulary, np.where(good, -z, 1)))[max_features:]] = False
    if not good.any():
        return none
    number = np.where(good, np.cumsum(good) - 1, -1)[place]
    keep = number >= 0
    del values, place
    rows, number, size = rows[keep], number[keep], int(good.sum())
    evidence = np.bincount(rows, fit_ordinal(rows, number, grades, size, 2)[0][number], n)
    toxic = np.flatnonzero(grades)
    place = np.empty(len(toxic), np.int64)
    place[np.lexsort((toxic, evidence[toxic]))] = np.arange(len(toxic))
    grades[toxic] = 1 + place * (GRADES - 1) // len(toxic)
    weights, thresholds = fit_ordinal(rows, number, grades, size, len(np.unique(grades)))
    thresholds = np.concatenate((thresholds, thresholds[-1] + np.arange(1, GRADES - len(thresholds))))  # grades that few toxic documents leave empty
    return OrdinalModel(vocabulary[good], weights, thresholds)


def score_texts(model: OrdinalModel, texts: list[str]) -> np.ndarray:
    """P(grade >= 1), P(grade >= 2) ... for each text."""
    n = len(texts)
    marks: list[np.ndarray] = []
    if len(model.words):
        for keys, parts in K.grouped(_pieces(texts), _CHUNK):
            h, place = _word_hashes(parts)
            at = np.minimum(np.searchsorted(model.words, h), len(model.words) - 1)
            hit = model.words[at] == h
            marks.append(np.unique(np.array(keys, np.int64)[place[hit]] * len(model.words) + at[hit]))
    found = np.unique(np.concatenate(marks)) if marks else np.zeros(0, np.int64)
    size = max(1, len(model.words))
    return model.probabilities(np.bincount(found // size, model.weights[found % size] if len(found) else None, n).astype(float))


SCORES = "expected_severity double, p_toxic double, grade int, rejected boolean"


def _scored(docs: DataFrame, model: OrdinalModel, reject_at: float) -> DataFrame:
    """doc_id and SCORES."""
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.weights, model.thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OrdinalModel(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                p = score_texts(own, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(p.sum(axis=1).round(9)), pa.array(p[:, 0].round(9)), pa.array((p >= 0.5).sum(axis=1).astype(np.int32)), pa.array(p[:, 0] >= reject_at)],
                    names=["doc_id", "expected_severity", "p_toxic", "grade", "rejected"],
                )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(tidied(run), "doc_id long, " + SCORES)


def score(docs: DataFrame, labels: DataFrame, reject_at: float = REJECT_AT, **training) -> DataFrame:
    """(doc_id, expected_severity, p_toxic, grade, rejected) for every row of docs."""
    return _scored(docs, train(docs, labels, **training), reject_at)


def reject_toxic(docs: DataFrame, labels: DataFrame, reject_at: float = REJECT_AT, **training) -> DataFrame:
    """docs without the rows that the model rejects; columns unchanged."""
    model = train(docs, labels, **training)
    shared = docs.sparkSession.sparkContext.broadcast((model.words, model.weights, model.thresholds))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OrdinalModel(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield part.filter(pa.array(score_texts(own, part.column(place).to_pylist())[:, 0] < reject_at))

    return docs.mapInArrow(tidied(run), docs.schema)
