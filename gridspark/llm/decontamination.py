"""Benchmark decontamination by greedy string tiling.

Words of documents and benchmark items are hashed; a rolling Karp-Rabin hash over
`least` words gives seeds, which join documents with items. For each pair the
seeds extend to maximal matches, and the longest match whose words are free in
both texts becomes a tile, again and again, down to `least` words. The share of
an item's words under tiles is its coverage, in whatever order its parts appear.

The benchmark is held by every task, in blocks of a checked size: one over
`BLOCK_BYTES` is split by item and the documents are read once a block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import Hasher, letter_words, mix, slices, string_buffers
from .workspace import free_names

LEAST_WORDS = 4
COVERAGE = 0.5
BLOCK_BYTES = 16_000_000
#: Places in items, or seeds of a pair, that are laid out at a time.
EXPANDED = 1_000_000

SCHEMA = "doc_id long, item_id long, item_words long, tiled_words long, coverage double, n_tiles long, longest_tile long, tiles string"


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, number in its document) of each word of lower-cased texts; punctuation parts words."""
    raw, offs = string_buffers(column)
    start, end, doc = letter_words(raw, offs)
    first = np.searchsorted(doc, np.arange(len(offs) - 1))
    return Hasher(raw).ranges(start, end), doc, np.arange(len(doc)) - first[doc] if len(doc) else doc


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all k-word windows."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    acc = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return mix(acc)


class BenchmarkIndex:
    """Seeds of a block of items, by window length: for each distinct window hash the items and places
    it comes from, and for each item its windows."""

    def __init__(self, ids: list[int | None], texts: list[str | None], least: int = LEAST_WORDS):
        self.ids, self.least = ids, least
        h, doc, _ = word_hashes(pa.array([(t or "").lower() for t in texts], pa.string()))
        cuts = np.searchsorted(doc, np.arange(len(ids) + 1))
        words = [h[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.lengths = np.diff(cuts)
        self.tables = {}
        for k in range(1, least + 1):  # an item of under `least` words is a seed as a whole
            rows = [(i, w) for i, w in enumerate(words) if (len(w) == k if k < least else len(w) >= k)]
            if rows:
                self.tables[k] = _Seeds(k, len(ids), rows)


class _Seeds:
    """The k-word windows of items: postings by distinct hash, and windows by item."""

    def __init__(self, k: int, n_items: int, rows: list[tuple[int, np.ndarray]]):
        item = np.concatenate([np.full(len(w) - k + 1, i) for i, w in rows])
        place = np.concatenate([np.arange(len(w) - k + 1) for _, w in rows])
        self.distinct, window, count = np.unique(np.concatenate([rolling(w, k) for _, w in rows]), return_inverse=True, return_counts=True)
        order = np.argsort(window, kind="stable")
        self.count, self.first = count, np.cumsum(count) - count
        self.item, self.place = item[order], place[order]
        own = np.lexsort((place, window, item))  # an item's windows by hash
        self.own_window, self.own_place = window[own], place[own]
        self.own_cuts = np.searchsorted(item[own], np.arange(n_items + 1))

    def candidates(self, k: int, doc: np.ndarray, window: np.ndarray, lengths: np.ndarray, coverage: float) -> Iterator[tuple[int, int]]:
        """(document, item) of which windows in common cover enough of the item, of a document's windows by document.

        A window counts once a document, however often it is there. Documents are
        taken together up to EXPANDED places of items; one document has at most as
        many as the index.
        """
        both = np.unique(doc * len(self.distinct) + window)
        doc, window = np.divmod(both, len(self.distinct))
        ends = np.cumsum(self.count[window])
        last = np.flatnonzero(np.concatenate([doc[1:] != doc[:-1], [True]]))  # of each document
        at = 0
        while at < len(doc):
            used = ends[at - 1] if at else 0
            fits = int(np.searchsorted(ends[last], used + EXPANDED, side="right"))
            to = int(last[max(fits - 1, int(np.searchsorted(last, at)))]) + 1
            n = self.count[window[at:to]]
            total = np.cumsum(n)
            source = np.repeat(self.first[window[at:to]] - (total - n), n) + np.arange(total[-1])
            pair, place = np.repeat(doc[at:to], n) * len(lengths) + self.item[source], self.place[source]
            order = np.lexsort((place, pair))
            pair, place = pair[order], place[order]
            new = np.concatenate([[True], pair[1:] != pair[:-1]])
            gap = np.full(len(place), k)
            same = ~new[1:]
            gap[:-1][same] = np.minimum(k, (place[1:] - place[:-1])[same])
            pairs = pair[new]
            good = np.add.reduceat(gap, np.flatnonzero(new)) >= coverage * lengths[pairs % len(lengths)]
            yield from (divmod(int(x), len(lengths)) for x in pairs[good])
            at = to

    def matches(self, k: int, item: int, window: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in document, place in item, words) of the maximal matches of a document's windows, by place, and an item."""
        own = slice(self.own_cuts[item], self.own_cuts[item + 1])
        lo, hi = (np.searchsorted(self.own_window[own], window, side=s) for s in ("left", "right"))
        some = np.flatnonzero(hi > lo)
        number, lo, n = number[some], lo[some], (hi - lo)[some]
        parts = []
        for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // EXPANDED)) + 1):
            total = np.cumsum(n[part])
            d = np.repeat(number[part], n[part])
            p = self.own_place[own][np.repeat(lo[part] - (total - n[part]), n[part]) + np.arange(total[-1])]
            parts.append(_join_runs(d, p, np.ones(len(d), dtype=np.int64)))
        d, p, seeds = _join_runs(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        return d, p, seeds + k - 1


def _join_runs(d: np.ndarray, p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (places in either text, seeds) that follow on each other in both texts, made one."""
    order = np.lexsort((p, d - p))
    d, p, n = d[order], p[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1] + n[:-1]) | (p[1:] != p[:-1] + n[:-1])]))
    return d[new], p[new], np.add.reduceat(n, new)


def tile(runs: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, item_words: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in document, place in item, length) of one pair, from its maximal matches.

    The longest match goes first; of equal ones that of the least place in the document, then in the item.
    """
    queue = [(-n, i, j) for i, j, n in zip(*(x.tolist() for x in runs), strict=True)]
    heapq.heapify(queue)
    in_doc: set[int] = set()
    in_item = np.zeros(item_words, dtype=bool)
    tiles = []
    while queue and not in_item.all():
        n, i, j = heapq.heappop(queue)
        free = [not in_item[j + x] and (i + x) not in in_doc for x in range(-n)]
        if all(free):
            tiles.append((i, j, -n))
            in_doc.update(range(i, i - n))
            in_item[j : j - n] = True
            continue
        at = 0
        while at < -n:  # what is left of a match goes back if it is long enough
            if not free[at]:
                at += 1
                continue
            end = at
            while end < -n and free[end]:
                end += 1
            if end - at >= k:
                heapq.heappush(queue, (-(end - at), i + at, j + at))
            at = end
    return sorted(tiles)


def matches(index: BenchmarkIndex, column: pa.Array, coverage: float = COVERAGE) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(document, item, tiles) of the pairs of at least that coverage, for a column of lower-cased texts.

    Seeds are first counted by pair; only pairs whose seeds could cover enough keep their places.
    """
    words, doc, number = word_hashes(column)
    for k, seeds in index.tables.items():
        h = rolling(words, k)
        if not len(h):
            continue
        window = np.minimum(np.searchsorted(seeds.distinct, h), len(seeds.distinct) - 1)
        good = np.flatnonzero((seeds.distinct[window] == h) & (doc[: len(h)] == doc[k - 1 :]))
        if not len(good):
            continue
        d, window, place = doc[good], window[good], number[good]
        for number_d, number_i in seeds.candidates(k, d, window, index.lengths, coverage):
            of = slice(*np.searchsorted(d, [number_d, number_d + 1]))
            size = int(index.lengths[number_i])
            tiles = tile(seeds.matches(k, number_i, window[of], place[of]), k, size)
            if sum(t[2] for t in tiles) >= coverage * size:
                yield number_d, number_i, tiles


def _blocks(benchmark: DataFrame) -> list[tuple[list, list]]:
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_BYTES))
    for i in range(n):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).collect()
        if part:
            yield [r.item_id for r in part], [r.text for r in part]


def find_contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST_WORDS) -> DataFrame:
    """One row per document and item whose words are covered to `coverage` or more; see SCHEMA.

    `tiles` lists place in document : place in item : length, in words. Null and
    empty texts on either side match nothing; repeated rows of a table give rows
    each; other columns are not read; empty tables give no row.
    """
    spark = docs.sparkSession
    low = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
    out = None
    for ids, texts in _blocks(benchmark):
        shared = spark.sparkContext.broadcast((ids, texts))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = BenchmarkIndex(*shared.value, least)
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            for batch in slices(batches):
                docs_of = batch.column(0)
                rows = []
                for d, i, tiles in matches(index, batch.column(1), coverage):
                    size, tiled = int(index.lengths[i]), sum(t[2] for t in tiles)
                    rows.append((docs_of[d].as_py(), index.ids[i], size, tiled, tiled / size, len(tiles), max(t[2] for t in tiles), ",".join(":".join(map(str, t)) for t in tiles)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64()] * 4 + [pa.float64()] + [pa.int64()] * 2 + [pa.string()], strict=True)], names=names)

        found = low.mapInArrow(work, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST_WORDS) -> DataFrame:
    """`docs` without the documents that cover some benchmark item; all else as it is.

    Documents of null and empty texts stay; rows that repeat stay or go alike; without
    items all rows stay, and an empty table gives no row.
    """
    (low,) = free_names(docs.columns, "low_text")
    for ids, texts in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast((ids, texts))
        names = docs.columns

        def work(batches: Iterator[pa.RecordBatch], shared=shared, names=names) -> Iterator[pa.RecordBatch]:
            index = BenchmarkIndex(*shared.value, least)
            for batch in slices(batches, low):
                keep = np.ones(batch.num_rows, dtype=bool)
                for d, _, _ in matches(index, batch.column(len(names)), coverage):
                    keep[d] = False
                yield batch.select(names).filter(pa.array(keep))

        docs = docs.withColumn(low, F.lower(F.col("text").cast("string"))).mapInArrow(work, docs.schema)
    return docs
