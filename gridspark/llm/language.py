"""Language identification by nearest centroid.

A text is a vector of hashed byte bi- and trigrams of its lower-cased letters,
weighted by TF-IDF and normalised. Each language has several centroids, from
spherical k-means over its training texts; a text gets the language of the
centroid of the largest cosine. A text further from that centroid than nearly all
of its training texts is marked as rejected. Every language of the training texts is
learned, each by a task of its own; only its centroids come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .selection import fold
from .textvec import slices, string_buffers
from .workspace import remove, write_table

BITS = 12
CENTROIDS = 4
#: Bounds on the training documents that a fit reads: of each language, and of all together
#: (with many languages each gets an equal share of it, at least one).
PER_LANGUAGE, TRAINING_ROWS = 800, 100_000
#: Bound on the model, which every worker holds; more languages than fit are an error, not left out.
MODEL_BYTES = 256_000_000
#: Share of a centroid's training texts that its rejection distance leaves out.
REJECTED = 0.005
_ROWS = 1000
#: Bytes of a centroid.
_CENTROID = 4 << BITS

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"

_fold = np.full(256, 32, dtype=np.uint8)  # what is no letter reads as a space
_fold[97:123] = np.arange(97, 123)
_fold[128:] = np.arange(128, 256)


def counts(column: pa.Array) -> np.ndarray:
    """Rows of hashed n-gram counts, for a column of lower-cased texts."""
    raw, offs = string_buffers(column)
    n = len(offs) - 1
    x = _fold[raw].astype(np.uint32)
    doc = np.repeat(np.arange(n), np.diff(offs))
    out = np.zeros(n << BITS)
    for k in (2, 3):
        if len(x) < k:
            continue
        gram = np.full(len(x) - k + 1, k, dtype=np.uint32)
        for i in range(k):
            gram = gram * np.uint32(257) + x[i : len(x) - k + 1 + i]
        blank = (x[: len(gram)] == 32) & (x[1 : len(gram) + 1] == 32)
        bin_ = (gram * np.uint32(2654435761)) >> np.uint32(32 - BITS)
        ok = (doc[: len(gram)] == doc[k - 1 :]) & ~blank
        out += np.bincount((doc[: len(gram)][ok] << BITS) + bin_[ok], minlength=n << BITS)
    return out.reshape(n, 1 << BITS)


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script; false for nulls."""
    raw, offs = string_buffers(texts)
    lower = raw | 0x20
    plain = np.concatenate([[0], np.cumsum((lower >= 97) & (lower <= 122))])
    high = np.concatenate([[0], np.cumsum(raw >= 128)])
    found = plain[offs[1:]] > plain[offs[:-1]]
    for i in np.flatnonzero(~found & (high[offs[1:]] > high[offs[:-1]])):
        found[i] = any(c.isalpha() for c in raw[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    owner: np.ndarray
    least: np.ndarray

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        v = np.log1p(rows) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def _kmeans(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; starts from the mean's nearest row, then the rows furthest from those taken."""
    mean = rows.mean(axis=0)
    taken = [int(np.argmax(rows @ mean))]
    while len(taken) < min(k, len(rows)):
        near = (rows @ rows[taken].T).max(axis=1)
        taken.append(int(np.argmin(near)))
    centre = rows[taken]
    for _ in range(rounds):
        own = np.argmax(rows @ centre.T, axis=1)
        new = np.stack([rows[own == i].sum(axis=0) if (own == i).any() else centre[i] for i in range(len(centre))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, centre):
            break
        centre = new
    return centre


def train(vectors: np.ndarray, k: int = CENTROIDS, rejected: float = REJECTED) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, least cosines) of one language; texts under a centroid's least cosine are far from it."""
    centre = _kmeans(vectors, k)
    cosine = vectors @ centre.T
    own = np.argmax(cosine, axis=1)
    return centre, np.array([np.quantile(cosine[own == i, i], rejected) if (own == i).any() else 0.0 for i in range(len(centre))])


def _lowered(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"), *columns)


def _training_vectors(docs: DataFrame, bound: int, total: int) -> tuple[DataFrame, str]:
    """(lang, doc_id, packed): the n-gram counts of each language's documents of the least hashes; a table that it reads."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.octet_length(F.col("text").cast("string")).alias("size"))
    named = named.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.col("size") > 0)).select("doc_id", "lang")
    sizes, sizes_path = write_table(named.groupBy("lang").agg(F.count(F.lit(1)).alias("documents")), "language-sizes")
    languages = sizes.count()
    if languages * CENTROIDS * _CENTROID > MODEL_BYTES:
        raise ValueError(f"lang has {languages} values: {CENTROIDS} centroids of each are over {MODEL_BYTES} bytes")
    each = max(1, min(bound, total // max(languages, 1)))
    # hashes are even, so about twice the rows wanted lie under this share of their range; only those are ranked
    share = F.least(F.lit(1.0), F.lit(2.0 * each + 200) / F.col("documents"))
    low = named.join(F.broadcast(sizes), "lang").filter(F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5 <= share).select("lang", "doc_id").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen, chosen_path = write_table(low.withColumn("place", place).filter(F.col("place") <= each).select("lang", F.col("doc_id").alias("chosen_id")), "language-chosen")  # at most `total` rows, or one a language
    remove(docs.sparkSession, sizes_path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            for at in range(0, part.num_rows, _ROWS):
                piece = part.slice(at, _ROWS)
                rows = np.minimum(counts(piece.column(1)), 65535).astype(np.uint16)
                rows[~has_letter(piece.column(1))] = 0
                some = [np.flatnonzero(row).astype(np.uint16) for row in rows]
                packed = [np.concatenate([x, row[x]]).tobytes() for x, row in zip(some, rows, strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(2), piece.column(0), pa.array(packed, pa.binary())], names=["lang", "doc_id", "packed"])

    texts = _lowered(docs, F.col("lang").cast("string").alias("lang"))
    wanted = F.broadcast(chosen.withColumnRenamed("lang", "chosen_lang"))
    picked = texts.join(wanted, (F.col("doc_id") == F.col("chosen_id")) & (F.col("lang") == F.col("chosen_lang")), "left_semi")
    found = picked.mapInArrow(work, "lang string, doc_id long, packed binary").filter(F.octet_length("packed") > 0)
    return found.groupBy("lang", "doc_id").agg(F.min("packed").alias("packed")), chosen_path  # rows that repeat an id are one text


def fit(docs: DataFrame, bound: int = PER_LANGUAGE, total: int = TRAINING_ROWS) -> Model | None:
    """A model of every language, from documents with `lang` and a letter; None without such documents."""
    spark = docs.sparkSession
    vectors, chosen_path = _training_vectors(docs, bound, total)
    sample, path = write_table(vectors, "language-sample")
    remove(spark, chosen_path)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(1 << BITS, dtype=np.int64), 0
        for batch in batches:
            for body in batch.column(0).to_pylist():
                both = np.frombuffer(body, dtype=np.uint16)
                seen[both[: len(both) // 2]] += 1
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([*range(1 << BITS), -1]), pa.array([*seen, n])], names=["bin", "n"])

    known = {r.bin: r.n for r in sample.select("packed").mapInArrow(bins, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    n = known.pop(-1, 0)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + np.array([known[i] for i in range(1 << BITS)]))) + 1

    def learn(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("packed").to_pylist(), strict=True))
        dense = np.zeros((len(rows), 1 << BITS), dtype=np.float32)
        for i, (_, body) in enumerate(rows):
            both = np.frombuffer(body, dtype=np.uint16)
            dense[i, both[: len(both) // 2]] = both[len(both) // 2 :]
        centre, least = train(Model(idf, dense, [], np.zeros(0), np.zeros(0)).vectors(dense))
        lang = table.column("lang")[0].as_py()
        return pa.table({"lang": [lang] * len(centre), "centre": [c.astype(np.float32).tobytes() for c in centre], "least": least})

    parts = sorted(sample.groupBy("lang").applyInArrow(learn, "lang string, centre binary, least double").collect())
    remove(spark, path)
    names = sorted({r.lang for r in parts})
    at = {name: i for i, name in enumerate(names)}
    return Model(idf, np.stack([np.frombuffer(r.centre, dtype=np.float32) for r in parts]), names, np.array([at[r.lang] for r in parts]), np.array([r.least for r in parts]))


def identify(docs: DataFrame, model: Model | None, folds: int = 3, held: int = 1) -> DataFrame:
    """One row per row of `docs`; see SCHEMA. `score` is the cosine to the nearest centroid.

    `und` with score 0, not rejected, for texts that are null or have no letter (and
    for all where nothing was learned). Ties go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                good = has_letter(part.column(1))
                if model is None:
                    best, score, far = ["und"] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows, bool)
                else:
                    cosine = model.vectors(counts(part.column(1))) @ model.centroids.T
                    near = np.argmax(cosine, axis=1)
                    top = cosine[np.arange(len(near)), near]
                    best = [model.languages[model.owner[i]] if g else "und" for i, g in zip(near, good, strict=True)]
                    score, far = np.where(good, np.clip(top, 0, 1), 0.0), good & (top < model.least[near])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(best, pa.string()), pa.array(score), pa.array(far)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return _lowered(docs).withColumn("held_out", fold(F.col("doc_id"), folds) == held).mapInArrow(work, SCHEMA)


def identify_documents(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """Learns outside the held-out fold and predicts for all documents: the op7 contract.

    Repeated rows are predicted each; `lang` is only read for learning; an empty table gives no row.
    """
    return identify(docs, fit(docs.filter(fold(F.col("doc_id").cast("long"), folds) != held)), folds, held)
