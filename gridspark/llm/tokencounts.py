"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

A pre-token is a word between white space with the word mark before it. Its token
count is the length of the segmentation into vocabulary pieces of the highest
summed log-probability. The distinct new pre-tokens of a batch share a trie: a
node is a prefix, its forward score is computed once, from those of its ancestors
and the pieces that end there, and terminal nodes hold the counts. Nodes of one
depth are computed together. Tries hold blocks of bounded size; a pre-token too long
for one is a path of its own, scored piece by piece. Known counts stay in a cache of
bounded size.

The log-probabilities are those that the corpus gives: one pass segments all texts by
first guesses (Zipf's law over the pieces' ranks), going back from each pre-token's terminal
node through the trie, and counts the pieces.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import Hasher, code_points, runs, slices, string_buffers

MARK = 0x2581
CACHE_ENTRIES = 1_500_000
#: Code points of a trie's words together, and of a word that is still put into a trie.
BLOCK, LONG = 200_000, 256
#: Score of a character that is no piece, under that of the least likely piece; it counts its UTF-8 bytes.
PENALTY = 10.0


@functools.cache
def pieces(path: str) -> dict[str, float]:
    """Log-probability of each ordinary piece: by Zipf's law, from its rank in the vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    total = float(np.log((1.0 / np.arange(1, len(names) + 1)).sum()))
    return {name: -float(np.log(rank)) - total for rank, name in enumerate(names, 1)}


def utf8_size(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)


@dataclass(frozen=True)
class _Steps:
    """Of a trie's nodes: the one before the last piece (their number: the root), that piece's length (0: a character
    that is none) and end; the nodes that words end in."""

    terminal: np.ndarray
    before: np.ndarray
    size: np.ndarray
    place: np.ndarray
    hasher: Hasher


class Counter:
    """Token counts of words, given as ranges of code points. `scores`: log-probabilities in the order of `pieces`."""

    def __init__(self, path: str, scores: np.ndarray | None = None):
        table = pieces(path) if scores is None else dict(zip(pieces(path), scores.tolist(), strict=True))
        self.longest = max(map(len, table))
        self.unknown = min(table.values()) - PENALTY
        codes = np.frombuffer("".join(table).encode("utf-32-le"), dtype=np.uint32)
        size = np.array([len(p) for p in table])
        end = np.cumsum(size)
        h = Hasher(codes).ranges(end - size, end)
        order = np.argsort(h)
        self.hashes, self.scores, self.order = h[order], np.array(list(table.values()))[order], order
        self.used = np.zeros(len(table), dtype=np.int64)  # occurrences of each piece, by `expect`
        self.spans, self.pool = np.zeros((0, 2), dtype=np.int64), np.zeros(0, dtype=np.int32)
        self.known, self.counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def _piece_scores(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.scores[at], -np.inf)

    def count_distinct(self, words: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Counts of distinct words: (code points, starts, ends)."""
        codes, start, end = words
        out = np.zeros(len(start), dtype=np.int64)
        long = end - start > LONG
        for i in np.flatnonzero(long):
            out[i] = self._count_path(codes[start[i] : end[i]])
        short = np.flatnonzero(~long)
        block = np.cumsum((end - start)[short]) // BLOCK
        for part in np.split(short, np.flatnonzero(np.diff(block)) + 1):
            out[part] = self._count_trie(codes, start[part], end[part])
        return out

    def _count_path(self, codes: np.ndarray, taken: np.ndarray | None = None) -> int:
        """The count of one long word, in memory of a bounded part of it. `taken` gets the length of the last piece by end (0: a character that is none)."""
        keep = self.longest + 1
        forward, tokens = [0.0] * keep, [0] * keep  # of the last ends, by end modulo `keep`
        for a in range(0, len(codes) + 1, BLOCK):
            b, back = min(a + BLOCK, len(codes) + 1), min(a, self.longest)
            part = codes[max(a - back - 1, 0) : b - 1]
            if a == back:
                part = np.concatenate([[MARK], part])
            hasher, found = Hasher(part.astype(np.uint32)), []
            for k in range(self.longest, 0, -1):  # longest first, as in a trie
                ends = np.arange(max(back + 1, k), len(part) + 1)
                score = self._piece_scores(hasher.ranges(ends - k, ends))
                some = np.flatnonzero(~np.isneginf(score))
                found.append((ends[some], np.full(len(some), k), score[some]))
            end, size, score = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(end, kind="stable")
            steps = zip(end[order].tolist(), size[order].tolist(), score[order].tolist(), strict=True)
            step, sizes = next(steps, None), utf8_size(part).tolist()
            for at in range(back + 1, len(part) + 1):
                best, n, alone, place, last = -np.inf, 0, True, a - back + at, 0
                while step is not None and step[0] == at:
                    before = (place - step[1]) % keep
                    alone &= step[1] > 1
                    if forward[before] + step[2] > best:
                        best, n, last = forward[before] + step[2], tokens[before] + 1, step[1]
                    step = next(steps, None)
                before = (place - 1) % keep
                if alone and forward[before] + self.unknown > best:
                    best, n, last = forward[before] + self.unknown, tokens[before] + sizes[at - 1], 0
                forward[place % keep], tokens[place % keep] = best, n
                if taken is not None:
                    taken[place] = last
        return tokens[(len(codes) + 1) % keep]

    def _expect_path(self, codes: np.ndarray, times: int) -> None:
        """Adds to `used` the pieces of one long word; the steps of its path take a few bytes a code point."""
        taken = np.zeros(len(codes) + 2, dtype=np.int32)
        self._count_path(codes, taken)
        on, at = np.zeros(len(taken), dtype=bool), len(codes) + 1
        while at:
            on[at] = True
            at -= max(int(taken[at]), 1)
        taken[~on] = 0  # what is left: the pieces, by their ends
        for a in range(0, len(taken), BLOCK):
            before = min(a, self.longest)
            part = codes[max(a - before - 1, 0) : a + BLOCK]
            if a == before:
                part = np.concatenate([[MARK], part])
            end = np.flatnonzero(taken[a : a + BLOCK])
            size, end = taken[a : a + BLOCK][end], end + before
            h = Hasher(part.astype(np.uint32)).ranges(end - size, end)
            self.used += times * np.bincount(self.order[np.searchsorted(self.hashes, h)], minlength=len(self.used))

    def expect(self, column: pa.Array, whole: bool = False) -> None:
        """Adds to `used` the pieces of the best segmentation of every word of some texts; of words over LONG only if `whole`.

        A word over LONG is a path of its own. The pieces of known words stay in a pool, bounded as the cache of counts is.
        """
        codes, at = code_points(*string_buffers(column))
        start, end, _ = runs(~((codes == 32) | ((codes >= 9) & (codes <= 13))), at)
        hasher, long = Hasher(codes), end - start > LONG
        if whole and long.any():
            a, b = start[long], end[long]
            _, index, times = np.unique(hasher.ranges(a, b), return_index=True, return_counts=True)
            for i, n in zip(index.tolist(), times.tolist(), strict=True):
                self._expect_path(codes[a[i] : b[i]], n)
        start, end = start[~long], end[~long]
        if not len(start):
            return
        distinct, index, times = np.unique(hasher.ranges(start, end), return_index=True, return_counts=True)
        place = np.searchsorted(self.known, distinct)
        there = place < len(self.known)
        there[there] = self.known[place[there]] == distinct[there]
        if not there.all():
            if len(self.known) > CACHE_ENTRIES:
                self.known, self.spans, self.pool = self.known[:0], self.spans[:0], self.pool[:0]
                there[:] = False
            new = np.flatnonzero(~there)
            a, b = start[index[new]], end[index[new]]
            number, found = [], []
            for part in np.split(np.arange(len(new)), np.flatnonzero(np.diff(np.cumsum(b - a) // BLOCK)) + 1):
                words, ids = self._pieces_of(codes, a[part], b[part])
                number.append(part[words])
                found.append(ids)
            number, found = np.concatenate(number), np.concatenate(found)
            order = np.argsort(number, kind="stable")
            size = np.bincount(number, minlength=len(new))
            spans = np.stack([len(self.pool) + np.cumsum(size) - size, size], axis=1)
            self.pool = np.concatenate([self.pool, found[order].astype(np.int32)])
            known = np.concatenate([self.known, distinct[new]])
            order = np.argsort(known, kind="stable")
            self.known, self.spans = known[order], np.concatenate([self.spans, spans])[order]
            place = np.searchsorted(self.known, distinct)
        first, size = self.spans[place].T
        total = np.cumsum(size)
        at = np.repeat(first - (total - size), size) + np.arange(total[-1])
        self.used += np.bincount(self.pool[at], weights=np.repeat(times, size), minlength=len(self.used)).astype(np.int64)

    def _pieces_of(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, piece) of the segmentation of each word, without characters that are no piece."""
        steps = self._count_trie(codes, start, end, steps=True)
        words, ids = [], []
        word, here = np.arange(len(start)), steps.terminal
        while len(here):  # all words take a step back at a time
            k, at = steps.size[here], steps.place[here]
            some = k > 0
            h = steps.hasher.ranges(at[some] + 1 - k[some], at[some] + 1)
            words.append(word[some])
            ids.append(self.order[np.searchsorted(self.hashes, h)])
            here = steps.before[here]
            left = here < len(steps.size)
            word, here = word[left], here[left]
        return np.concatenate(words), np.concatenate(ids)

    def _count_trie(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray, steps: bool = False) -> np.ndarray | _Steps:
        """The counts of words, or the steps of their segmentations."""
        size = end - start + 1
        first = np.cumsum(size) - size
        total = int(size.sum())
        if not total:
            return np.zeros(len(start), dtype=np.int64)
        owner = np.repeat(np.arange(len(start)), size)
        depth = np.arange(total) - first[owner]  # 0: the mark
        flat = np.full(total, MARK, dtype=np.uint32)
        inside = depth > 0
        flat[inside] = codes[(start[owner] + depth - 1)[inside]]
        hasher = Hasher(flat)
        ends = np.arange(1, total + 1)
        prefix = hasher.ranges(first[owner], ends)
        _, rep, node = np.unique(prefix, return_index=True, return_inverse=True)
        level = depth[rep] + 1
        n = len(rep)
        forward, tokens, taken = np.full(n + 1, -np.inf), np.zeros(n + 1, dtype=np.int64), np.zeros(n, dtype=np.int64)
        forward[n] = 0.0  # the root
        limit = min(self.longest, int(level.max()))
        sizes = np.arange(limit, 0, -1)  # longest first: ties go to the longer last piece
        score = np.full((n, limit + 1), -np.inf)
        ancestor = np.full((n, limit + 1), n, dtype=np.int64)
        for column, k in enumerate(sizes):
            ok = np.flatnonzero(level >= k)
            at = rep[ok]
            score[ok, column] = self._piece_scores(hasher.ranges(at + 1 - k, at + 1))
            deeper = level[ok] > k
            ancestor[ok[deeper], column] = node[at[deeper] - k]
        alone = np.isneginf(score[:, limit - 1])
        score[alone, limit] = self.unknown
        ancestor[:, limit] = ancestor[:, limit - 1]
        cost = np.ones((n, limit + 1), dtype=np.int64)
        cost[:, limit] = utf8_size(flat[rep])
        order = np.argsort(level, kind="stable")
        cuts = np.searchsorted(level[order], np.arange(1, int(level.max()) + 2))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            here = order[a:b]
            options = forward[ancestor[here]] + score[here]
            best = np.argmax(options, axis=1)
            rows = np.arange(len(here))
            forward[here] = options[rows, best]
            tokens[here] = tokens[ancestor[here, best]] + cost[here, best]
            taken[here] = best
        if steps:
            nodes = np.arange(n)
            return _Steps(node[first + size - 1], ancestor[nodes, taken], np.where(taken < limit, np.append(sizes, 0)[taken], 0), rep, hasher)
        return tokens[node[first + size - 1]]

    def count(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, words) of each text; null counts as empty."""
        raw, offs = string_buffers(column)
        codes, at = code_points(raw, offs)
        n_docs = len(at) - 1
        white = (codes == 32) | ((codes >= 9) & (codes <= 13))
        start, end, doc = runs(~white, at)
        if not len(start):
            return np.zeros(n_docs, dtype=np.int64), np.zeros(n_docs, dtype=np.int64)
        h = Hasher(codes).ranges(start, end)
        distinct, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, distinct)
        there = place < len(self.known)
        there[there] = self.known[place[there]] == distinct[there]
        new = ~there
        if new.any():
            counted = self.count_distinct((codes, start[index[new]], end[index[new]]))
            counts = np.zeros(len(distinct), dtype=np.int64)
            counts[there] = self.counts[place[there]]
            counts[new] = counted
            if len(self.known) > CACHE_ENTRIES:
                self.known, self.counts = self.known[:0], self.counts[:0]
            known = np.concatenate([self.known, distinct[new]])
            order = np.argsort(known, kind="stable")
            self.known, self.counts = known[order], np.concatenate([self.counts, counted])[order]
        else:
            counts = self.counts[place]
        return np.bincount(doc, weights=counts[inverse], minlength=n_docs).astype(np.int64), np.bincount(doc, minlength=n_docs)


@functools.cache
def shared_counter(path: str, scores: bytes | None = None) -> Counter:
    return Counter(path, None if scores is None else np.frombuffer(scores))


@functools.cache
def expecting_counter(path: str) -> Counter:
    """A worker's counter for `expect`; it keeps known words from task to task."""
    return Counter(path)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def estimate(docs: DataFrame, vocabulary: str, whole: bool = False) -> np.ndarray:
    """Log-probabilities of the pieces, in the order of `pieces`, from their occurrences in all texts: in all words
    if `whole`, as `count_documents` asks, else in those of up to LONG code points.

    A piece that never occurs counts as half an occurrence. Counts of pieces, as many as the
    vocabulary has, are summed on the executors and brought to the driver.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = expecting_counter(vocabulary)
        counter.used[:] = 0
        for batch in slices(batches):
            counter.expect(batch.column(1), whole)
        some = np.flatnonzero(counter.used)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counter.used[some])], names=["piece", "n"])

    used = np.full(len(pieces(vocabulary)), 0.5)
    for row in _texts(docs).mapInArrow(work, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        used[row.piece] = row.n
    return np.log(used) - np.log(used.sum())


def count_tokens(docs: DataFrame, vocabulary: str, scores: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_tokens, n_words of every row, by the log-probabilities `scores` (else by Zipf's law).

    Null, empty and blank texts have none; repeated rows are counted each; other
    columns are not read; an empty table gives no row. A text is held in memory whole. Nothing is shuffled.
    """
    given = None if scores is None else docs.sparkSession.sparkContext.broadcast(np.asarray(scores, dtype=np.float64).tobytes())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared_counter(vocabulary, None if given is None else given.value)
        for batch in slices(batches):
            tokens, words = counter.count(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens), pa.array(words)], names=["doc_id", "n_tokens", "n_words"])

    return _texts(docs).mapInArrow(work, "doc_id long, n_tokens long, n_words long")


def count_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """`count_tokens` by the log-probabilities that the same texts give."""
    return count_tokens(docs, vocabulary, estimate(docs, vocabulary, whole=True))
