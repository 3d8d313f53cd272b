"""Cost-balanced packing of tokenised documents into fixed-length sequences.

Each task tokenises its documents and packs them in windows of a bounded number
of tokens, so nothing is shuffled and memory does not grow with the data. Within
a window documents are taken by descending length; each goes to the sequence of
the lowest estimated cost (linear plus quadratic in the length of a document, as
attention stays within a document) that still has room. A window has as many
sequences as its tokens need, so a document that fits nowhere is cut to fill the
roomiest sequence: padding is below one sequence a window.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import DocumentTokenizer, shared_tokenizer
from .textvec import slices

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, sequence_cost double"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens")] + [("sequence_cost", pa.float64())])


class CheapestFit:
    """Sequences by remaining capacity; finds the cheapest with room for n tokens.

    A segment tree over the capacities holds the least (cost, sequence) of each,
    so one placement costs a logarithm of the capacity, not of the sequences.
    """

    def __init__(self, n: int, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.none = (float("inf"), -1)
        self.tree = [self.none] * (2 * self.size)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
        self.heaps[capacity] = [(0.0, i) for i in range(n)]
        self.capacity = capacity
        self._refresh(capacity)

    def _refresh(self, room: int) -> None:
        at = room + self.size
        self.tree[at] = self.heaps[room][0] if self.heaps[room] else self.none
        at //= 2
        while at:
            a, b = self.tree[2 * at], self.tree[2 * at + 1]
            self.tree[at] = a if a < b else b
            at //= 2

    def take(self, n: int) -> tuple[float, int, int] | None:
        """Removes the cheapest sequence with room for n: (cost, sequence, room)."""
        lo, hi, best, where = n + self.size, 2 * self.size, self.none, 0
        while lo < hi:
            if lo & 1:
                if self.tree[lo] < best:
                    best, where = self.tree[lo], lo
                lo += 1
            if hi & 1:
                hi -= 1
                if self.tree[hi] < best:
                    best, where = self.tree[hi], hi
            lo //= 2
            hi //= 2
        if best[1] < 0:
            return None
        while where < self.size:
            where = 2 * where if self.tree[2 * where] == best else 2 * where + 1
        room = where - self.size
        heapq.heappop(self.heaps[room])
        self._refresh(room)
        return best[0], best[1], room

    def roomiest(self) -> tuple[float, int, int]:
        """Removes a sequence of those with the most room."""
        room = max(r for r in range(self.capacity, -1, -1) if self.heaps[r])
        cost, seq = heapq.heappop(self.heaps[room])
        self._refresh(room)
        return cost, seq, room

    def put(self, cost: float, seq: int, room: int) -> None:
        heapq.heappush(self.heaps[room], (cost, seq))
        self._refresh(room)


def pack(lengths: list[int], capacity: int = 1024, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Places every token of every document: (document, start, length, sequence, offset).

    Cost of a piece of n tokens: linear * n + quadratic * n * n. Ties go to the
    document given first and the sequence of the lowest number.
    """
    out: list[tuple[int, int, int, int, int]] = []
    seq = 0
    rest: list[tuple[int, int, int]] = []
    for doc, n in enumerate(lengths):
        full = n // capacity
        out += [(doc, i * capacity, capacity, seq + i, 0) for i in range(full)]
        seq += full
        if n % capacity:
            rest.append((-(n % capacity), doc, full * capacity))
    total = -sum(r[0] for r in rest)
    fit = CheapestFit(-(-total // capacity), capacity)
    heapq.heapify(rest)
    while rest:
        n, doc, start = heapq.heappop(rest)
        n = -n
        got = fit.take(n)
        if got is None:
            got = fit.roomiest()
            cut = got[2]
            heapq.heappush(rest, (-(n - cut), doc, start + cut))
            n = cut
        cost, at, room = got
        out.append((doc, start, n, seq + at, capacity - room))
        fit.put(cost + linear * n + quadratic * n * n, at, room - n)
    return out


def _windows(batches: Iterator[pa.RecordBatch], tokens: DocumentTokenizer, limit: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    ids, seqs, held = [], [], 0
    for batch in slices(batches):
        ids += batch.column(0).to_pylist()
        for x in tokens.encode(batch.column(1)):
            seqs.append(np.append(x, 0).astype("<u4"))
            held += len(x) + 1
        if held >= limit:
            yield ids, seqs
            ids, seqs, held = [], [], 0
    if ids:
        yield ids, seqs


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, window_tokens: int = 2_000_000, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> DataFrame:
    """One row per piece of a packed document; see SCHEMA.

    A document is its ids of the byte-level BPE at `vocabulary`, then id 0. Null
    and empty texts are the single id 0; repeated rows (and null ids) are packed
    row by row; other columns of `docs` are not read; an empty table gives no row.
    Sequence ids are unique: the task's number, then a counter.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared_tokenizer(vocabulary)
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for ids, seqs in _windows(batches, tokens, window_tokens):
            pieces = pack([len(s) for s in seqs], capacity, linear, quadratic)
            doc, start, length, seq, offset = (np.array(x, dtype=np.int64) for x in zip(*pieces, strict=True))
            crc = [zlib.crc32(seqs[d][s : s + n].tobytes()) for d, s, n, _, _ in pieces]
            used = np.bincount(seq, weights=length).astype(np.int64)
            cost = np.bincount(seq, weights=linear * length + quadratic * length * length)
            sizes = np.array([len(s) for s in seqs], dtype=np.int64)
            keys = pa.array(ids, pa.int64()).take(pa.array(doc))
            columns = [keys, start, length, np.array(crc, dtype=np.int64), sizes[doc], base + seq, offset, used[seq], cost[seq]]
            yield from pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=_ARROW).to_batches(max_chunksize=20_000)
            base += int(seq.max()) + 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, SCHEMA)
