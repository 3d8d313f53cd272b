"""Quality by importance resampling: target against raw hashed n-gram models, Gumbel top-k.

Two bags of hashed n-grams are counted: over labelled good documents (target) and
over all documents (raw). A document's log-weight is the log-ratio of the two models
over its n-grams; one of more than REFERENCE n-grams weighs as an average passage of
REFERENCE of them, so that length alone makes no weight. Standard Gumbel noise, fixed
by a document's id, is added and the k largest keys are kept: a sample without
replacement in proportion to the weights. k is the number of documents whose weight
reaches the cut that best parts labelled good from bad documents which the target
model has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .selection import kth_largest, only_ids, sample_ids
from .textvec import Hasher, runs, slices, string_buffers
from .workspace import free_names, written

BUCKETS = 1 << 16
#: Bound on the labelled rows that a fit reads, of either label.
LABELLED_ROWS = 8000
#: Every FOLDS-th labelled good document is left out of the target model and finds the cut.
FOLDS = 4
#: n-grams up to which a log-weight is their sum; that of longer texts is scaled to so many.
REFERENCE = 128

_kind = np.zeros(256, dtype=np.uint8)
_kind[33:128] = 2
_kind[48:58] = _kind[65:91] = _kind[97:123] = _kind[128:] = 1


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of the uni- and bigrams of each text, case kept.

    Words and runs of punctuation are symbols of their own. A symbol that repeats
    the one before it (or before a run of punctuation) gives a bigram of its own kind.
    """
    raw, offs = string_buffers(column)
    kind = _kind[raw]
    words, marks = runs(kind == 1, offs), runs(kind == 2, offs)
    start = np.concatenate([words[0], marks[0]])
    order = np.argsort(start, kind="stable")
    start, end, doc = start[order], np.concatenate([words[1], marks[1]])[order], np.concatenate([words[2], marks[2]])[order]
    h = Hasher(raw).ranges(start, end)
    if not len(h):
        return np.zeros(0, dtype=np.int64), doc
    pair = h[1:] * np.uint64(0x9E3779B97F4A7C15) + h[:-1]
    pair[h[1:] == h[:-1]] = 1
    inside = doc[1:] == doc[:-1]
    skip = np.full(max(len(h) - 2, 0), 2, dtype=np.uint64)
    again = (h[2:] == h[:-2]) & (doc[2:] == doc[:-2]) if len(h) > 2 else np.zeros(0, dtype=bool)
    all_h = np.concatenate([h, pair[inside], skip[again]])
    all_d = np.concatenate([doc, doc[1:][inside], doc[2:][again] if len(h) > 2 else doc[:0]])
    mixed = (all_h ^ (all_h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(48)).astype(np.int64), all_d


@dataclass(frozen=True)
class Model:
    """Log-ratios by bucket and the cut on a document's weight."""

    ratio: np.ndarray
    cut: float = 0.0

    def weights(self, column: pa.Array) -> np.ndarray:
        bucket, doc = features(column)
        total = np.bincount(doc, weights=self.ratio[bucket], minlength=len(column)).astype(np.float64)
        return total * np.minimum(1.0, REFERENCE / np.maximum(np.bincount(doc, minlength=len(column)), 1))


def _counts(docs: DataFrame, target_ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts by bucket over the target rows and over all rows."""
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(target_ids, dtype=np.int64)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, raw = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in slices(batches):
            bucket, doc = features(batch.column(1))
            raw += np.bincount(bucket, minlength=BUCKETS)
            good = np.isin(batch.column(0).fill_null(-(1 << 62)).to_numpy(), shared.value)
            target += np.bincount(bucket[good[doc]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(target[some]), pa.array(raw[some])], names=["bucket", "target", "raw"])

    rows = docs.mapInArrow(work, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toPandas()
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    target[rows["bucket"]], raw[rows["bucket"]] = rows["target"], rows["raw"]
    return target, raw


def _keep_columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def best_cut(good: np.ndarray, bad: np.ndarray, slack: float = 0.005) -> float:
    """The lowest cut that parts good from bad weights within `slack` of the best.

    Parting is the share of good weights at or above the cut plus that of bad ones
    below it; the lowest such cut leaves room for good documents unlike the labelled.
    """
    if not len(good):
        return -np.inf
    if not len(bad):
        return float(good.min()) - 1e-6
    places = np.unique(np.concatenate([good, np.nextafter(bad, np.inf)]))
    kept = 1 - np.searchsorted(np.sort(good), places) / len(good)
    gone = np.searchsorted(np.sort(bad), places) / len(bad)
    fine = kept + gone >= (kept + gone).max() - slack
    return float(places[int(np.argmax(fine))])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, log_weight of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.weights(batch.column(1)))], names=["doc_id", "log_weight"])

    return _keep_columns(docs).mapInArrow(work, "doc_id long, log_weight double")


def sampling_key(weight: str) -> Column:
    """A log-weight plus standard Gumbel noise that doc_id fixes."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), F.lit("gumbel")), 11).cast("double") + 0.5) / float(1 << 53)
    return F.col(weight) - F.log(-F.log(uniform))


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABELLED_ROWS) -> Model:
    """Models over all documents; the target and the cut from up to `bound` labelled rows of either label.

    Of the good ones every FOLDS-th is not counted into the target; these and the bad
    ones give the cut. A document with both labels is bad. Without labelled good
    documents every ratio is 0 and nothing is rejected.
    """
    docs = _keep_columns(docs)
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    ids = {q: sample_ids(known.filter(F.col("quality") == q), "doc_id", bound) for q in (1, 0)}
    held = ids[1][::FOLDS] if len(ids[1]) >= 2 * FOLDS else ids[1]
    target, raw = _counts(docs, sorted(set(ids[1]) - set(held)) or ids[1])
    if not target.sum():
        return Model(np.zeros(BUCKETS), -np.inf)
    ratio = np.log((target + 0.5) / (target.sum() + 0.5 * BUCKETS)) - np.log((raw + 0.5) / (raw.sum() + 0.5 * BUCKETS))
    rows = score_documents(only_ids(docs, "doc_id", [*held, *ids[0]]), Model(ratio)).toPandas()
    good = rows[rows["doc_id"].isin(held)]["log_weight"].to_numpy()
    bad = rows[rows["doc_id"].isin(ids[0])]["log_weight"].to_numpy()
    return Model(ratio, best_cut(good, bad))


def threshold(docs: DataFrame, model: Model, k: int | None = None) -> tuple[DataFrame, float]:
    """(scores with keys, as a table; the k-th largest key): rows whose key reaches it are the sample."""
    scores = written(score_documents(docs, model).withColumn("sampling_key", sampling_key("log_weight")), "quality-scores")
    if k is None:
        k = scores.filter(F.col("log_weight") >= model.cut).count()
    least = kth_largest(scores, "sampling_key", k)
    return scores, float("inf") if least is None else least


def sample_documents(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The sampled rows: doc_id, log_weight, sampling_key.

    `k` rows, by default as many as pass the cut; rows tied at the k-th key all stay,
    so rows that repeat an id and text stay together. Null and empty texts have
    weight 0. Other columns are not read; an empty table gives no row.
    """
    scores, least = threshold(docs, fit(docs, labels), k)
    return scores.filter(F.col("sampling_key") >= F.lit(least))


def keep_documents(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """`docs` without the rows that the sampling rejects; columns as they are, nothing is shuffled.

    Null and empty texts have weight 0 and stay or go by that; rows that repeat an id
    and text stay or go together; an empty table gives no row.
    """
    model = fit(docs, labels)
    _, least = threshold(docs, model, k)
    names = docs.columns
    text, weight = free_names(names, "text_of", "weight_of")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            arrays = [*batch.columns, pa.array(model.weights(batch.column(len(names))))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, weight])

    wide = docs.withColumn(text, F.col("text").cast("string"))
    scored = wide.mapInArrow(work, T.StructType([*wide.schema.fields, T.StructField(weight, T.DoubleType())]))
    return scored.filter(sampling_key(weight) >= F.lit(least)).select(*names)
