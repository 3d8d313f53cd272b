"""Toxicity by multiple-instance learning: sentences scored, documents labelled.

A document is a bag of sentences. A sentence's probability is a logistic function
of its hashed words and their beginnings; a document's is the noisy-or of its sentences: one minus the
chance that none is toxic. The weights are fitted to document labels alone, by
gradient steps through the noisy-or, and then locate the offending sentences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .selection import fold, sample_ids
from .textvec import Hasher, letter_words, slices, string_buffers

BITS = 20
#: Beginnings of words, in bytes, that are features beside whole words.
PREFIXES = (4, 5, 6)
#: Bounds on the labelled documents that a fit reads: how many of either label, and the bytes of each.
LABELLED_ROWS, LABELLED_BYTES = 4000, 200_000
PREDICT_AT = 0.3
#: Standard errors by which label 1 must have a feature more often for it to get a weight.
SIGNIFICANT = 4.0

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_sentences long, n_offending long, worst_start long, worst_end long, worst_score double, offending array<struct<start:bigint,end:bigint,score:double>>"

_stop = np.zeros(256, dtype=bool)
_stop[[10, 33, 46, 63]] = True  # line feed ! . ?


@dataclass(frozen=True)
class Bags:
    """Features by sentence: `word` and `sentence` per feature; `first`: where each document's sentences
    begin, of n + 1; `start` and `end` of each sentence in its text, in code points."""

    word: np.ndarray
    sentence: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray


def sentences(column: pa.Array) -> Bags:
    """Sentences end after . ! ? or a line feed; those without words are left out. Texts are lower-cased already."""
    raw, offs = string_buffers(column)
    start, end, doc = letter_words(raw, offs)
    n = len(offs) - 1
    if not len(start):
        z = np.zeros(0, dtype=np.int64)
        return Bags(z, z, np.zeros(n + 1, dtype=np.int64), z, z)
    hasher = Hasher(raw)
    stops = np.concatenate([[0], np.cumsum(_stop[raw])])
    part = stops[start]
    new = np.concatenate([[True], (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])])
    sentence = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    base = points[offs[doc[heads]]]
    last = end[np.append(heads[1:], len(start)) - 1]
    hashes, owner = [hasher.ranges(start, end)], [sentence]
    for size in PREFIXES:
        long = np.flatnonzero(end - start >= size)
        hashes.append(hasher.ranges(start[long], start[long] + size) * np.uint64(2 * size + 1))
        owner.append(sentence[long])
    h = (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)
    return Bags(h, np.concatenate(owner), np.searchsorted(doc[heads], np.arange(n + 1)), points[start[heads]] - base, points[last] - base)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def sentence_logits(self, bags: Bags) -> np.ndarray:
        return np.bincount(bags.sentence, weights=self.weights[bags.word], minlength=int(bags.first[-1])) + self.bias


def noisy_or(logits: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One minus the chance that no sentence of a document is toxic; 0 without sentences."""
    none = np.concatenate([[0.0], np.cumsum(np.logaddexp(0, logits))])
    return -np.expm1(-(none[first[1:]] - none[first[:-1]]))


def train(word: np.ndarray, sentence: np.ndarray, first: np.ndarray, label: np.ndarray, share: float, rounds: int = 120, rate: float = 0.1, decay: float = 2e-3) -> Model:
    """Adam on the weighted noisy-or likelihood; `share`: that of label 1 among all labelled documents."""
    n_sent = int(first[-1])
    doc = np.searchsorted(first, np.arange(n_sent), side="right") - 1
    both = np.unique(sentence * (1 << BITS) + word)  # presence in a sentence, not count
    sentence, word = both >> BITS, both & ((1 << BITS) - 1)
    used, word = np.unique(word, return_inverse=True)
    ones = max(label.sum(), 1)
    weight = np.where(label == 1, share / ones, (1 - share) / max(len(label) - label.sum(), 1)) * len(label)
    w, b = np.zeros(len(used)), -5.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, rounds + 1):
        z = np.bincount(sentence, weights=w[word], minlength=n_sent) + b
        p = noisy_or(z, first)
        factor = np.where(label == 1, -(1 - p) / np.maximum(p, 1e-9), 1.0) * weight
        g_z = factor[doc] * np.exp(-np.logaddexp(0, -z)) / len(label)
        g = np.append(np.bincount(word, weights=g_z[sentence], minlength=len(used)), g_z.sum())
        g[:-1] += decay / len(label) * w
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    weights = np.zeros(1 << BITS)
    weights[used] = w
    return Model(weights, float(b))


def _lowered(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELLED_ROWS) -> Model:
    """A model from up to `bound` documents of either label; without both labels it scores 0.

    A document that several rows label is toxic if one of them says so. Labels of
    documents that are not there, or are over LABELLED_BYTES long, are not learned
    from, and without documents of both labels all scores are 0. Features are counted and chosen on the executors; only the chosen ones of the
    training documents come to the driver.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    ids = {t: sample_ids(known.filter(F.col("toxic") == t), "doc_id", bound) for t in (0, 1)}
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    nothing = Model(np.zeros(1 << BITS), -20.0)
    if not ids[0] or not ids[1]:
        return nothing
    truth = dict.fromkeys(ids[0], 0) | dict.fromkeys(ids[1], 1)
    marks = spark.createDataFrame(list(truth.items()), "marked_id long, label int")  # of bounded length
    learn = _lowered(docs).filter(F.octet_length("text") <= LABELLED_BYTES).join(F.broadcast(marks), F.col("doc_id") == F.col("marked_id")).select("doc_id", "text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            bags = sentences(part.column(1))
            doc = np.searchsorted(bags.first, bags.sentence, side="right") - 1
            pairs = np.unique((doc.astype(np.int64) << BITS) | bags.word)
            feature, has = pairs & ((1 << BITS) - 1), part.column(2).to_numpy()[pairs >> BITS] == 1
            some, place = np.unique(feature, return_inverse=True)
            n1 = np.bincount(place, weights=has, minlength=len(some)).astype(np.int64)
            n0 = np.bincount(place, weights=~has, minlength=len(some)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n1), pa.array(n0)], names=["feature", "n1", "n0"])

    sums = learn.mapInArrow(count, "feature long, n1 long, n0 long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    m1, m0 = len(ids[1]), len(ids[0])
    error = F.sqrt((F.col("n1") + F.col("n0") + 1) / (m1 + m0) * (1 / m1 + 1 / m0))
    chosen = sums.filter((F.col("n1") >= 3) & (F.col("n1") / m1 - F.col("n0") / m0 > SIGNIFICANT * error))
    kept = np.sort(np.array([r.feature for r in chosen.select("feature").collect()], dtype=np.int64))
    shared = spark.sparkContext.broadcast(kept)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            bags = sentences(part.column(1))
            good = np.isin(bags.word, shared.value)
            both = np.unique((bags.sentence[good] << BITS) | bags.word[good])
            cuts = np.searchsorted(both >> BITS, bags.first)
            bodies = [(both[a:b] - (bags.first[i] << BITS)).tobytes() for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.diff(bags.first)), pa.array(bodies, pa.binary())], names=["doc_id", "label", "n", "body"])

    rows = learn.mapInArrow(take, "doc_id long, label int, n long, body binary").collect()
    rows.sort(key=lambda r: (r.doc_id, r.body))
    if {r.label for r in rows} != {0, 1}:
        return nothing
    first = np.concatenate([[0], np.cumsum([r.n for r in rows])]).astype(np.int64)
    packed = np.concatenate([np.frombuffer(r.body, dtype=np.int64) + (f << BITS) for r, f in zip(rows, first, strict=False)])
    return train(packed & ((1 << BITS) - 1), packed >> BITS, first, np.array([r.label for r in rows]), counts[1] / (counts[0] + counts[1]))


def score_documents(docs: DataFrame, model: Model, folds: int = 4, held: int = 2, at: float = PREDICT_AT) -> DataFrame:
    """One row per row of `docs`; see SCHEMA.

    Null, empty and wordless texts have score 0 and no worst sentence. Offending
    sentences are those whose own probability is `at` or more, all listed in
    `offending` in the order of the text; the worst is the first of the highest
    probability. Each runs from its first word to its last.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in slices(batches):
            bags = sentences(batch.column(1))
            z = model.sentence_logits(bags)
            score = noisy_or(z, bags.first)
            own = np.exp(-np.logaddexp(0, -z))
            n = np.diff(bags.first)
            doc = np.repeat(np.arange(len(n)), n)
            bad = np.flatnonzero(own >= at)
            cuts = np.searchsorted(bad, bags.first)
            listed = pa.StructArray.from_arrays([pa.array(bags.start[bad], pa.int64()), pa.array(bags.end[bad], pa.int64()), pa.array(own[bad], pa.float64())], names=["start", "end", "score"])
            spans = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), listed)
            order = np.lexsort((np.arange(len(own)), -own, doc))
            worst = order[np.minimum(bags.first[:-1], max(len(order) - 1, 0))] if len(order) else np.zeros(len(n), dtype=np.int64)
            none = n == 0
            pick = lambda x, t: pa.array(x[worst] if len(x) else np.zeros(len(n)), t, mask=none)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= at).astype(np.int32)), pa.array(n), pa.array(np.diff(cuts)), pick(bags.start, pa.int64()), pick(bags.end, pa.int64()), pick(own, pa.float64()), spans], names=names)

    return _lowered(docs).withColumn("held_out", fold(F.col("doc_id"), folds) == held).mapInArrow(work, SCHEMA)


def judge_documents(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Fits on the labels outside the held-out fold and scores all documents: the op6 contract.

    Repeated rows are scored each; other columns are not read; an empty table gives no row.
    """
    learn = labels.filter(fold(F.col("doc_id").cast("long"), folds) != held)
    return score_documents(docs, fit(docs, learn), folds, held)
