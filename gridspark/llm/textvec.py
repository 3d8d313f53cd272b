"""Vectorised text primitives shared by the operators of this package.

Texts arrive as Arrow string columns. Everything works on whole buffers with
numpy: no Python object is made per word. Batches are cut into slices of a few
MB so that the working memory of a task stays bounded however many rows Spark
puts into an Arrow batch; a single text longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1_000_000

#: Odd multiplier of the polynomial hash (fixed value; 64-bit golden ratio).
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


_table = mix(np.arange(1, 257, dtype=U64))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept and grown by doubling."""
    have = _powers.get(base)
    if have is None:
        have = np.ones(1, dtype=U64)
    while len(have) <= n:
        step = U64(pow(base, len(have), 1 << 64))
        have = np.concatenate([have, have * step])
    if len(have) <= 4 * SLICE_BYTES:
        _powers[base] = have
    return have[: n + 1]


class Hasher:
    """Hashes of any ranges of one symbol array, from one cumulative sum."""

    def __init__(self, symbols: np.ndarray):
        if symbols.dtype == np.uint8:
            terms = _table[symbols]
        else:
            terms = mix(symbols.astype(U64) + U64(1))
        n = len(symbols)
        self.sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(terms * _power(_BASE, n)[:n], out=self.sums[1:])
        self.inverse = _power(_BASE_INV, n)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U64))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that each holds about `limit` text bytes at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = string_buffers(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def code_points(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points as uint32, offsets in code points). Malformed UTF-8 reads as U+FFFD."""
    try:
        text = raw.tobytes().decode("utf-8")
        starts = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=starts[1:])
        return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), starts[offs]
    except UnicodeDecodeError:
        parts = [np.frombuffer(raw[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32) for a, b in zip(offs[:-1], offs[1:], strict=True)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)


_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, dtype=bool)
_space[[0x20, 9, 10, 11, 12, 13]] = True
_letters = np.zeros(256, dtype=bool)
_letters[48:58] = _letters[65:91] = _letters[97:123] = _letters[128:] = True


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return _lower[raw]


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true symbols that stay within one document: start, end, document."""
    n = len(inside)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(offs, start, side="right") - 1


def space_words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between white space (space and U+0009 to U+000D)."""
    return runs(~_space[raw], offs)


def letter_words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ASCII letters, digits and non-ASCII characters: punctuation parts words."""
    return runs(_letters[raw], offs)


def doc_starts(doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Where each document's items begin, of items that are ordered by document."""
    return np.searchsorted(doc, np.arange(n_docs + 1))


def shingles(words: np.ndarray, doc: np.ndarray, n_docs: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every k-word shingle, repeats included, by document.

    A document with 1 to k-1 words gives its whole sequence as one shingle.
    """
    n = len(words)
    first = doc_starts(doc, n_docs)
    count = np.diff(first)
    out_h, out_d = [], []
    if n >= k:
        acc = np.zeros(n - k + 1, dtype=U64)
        for i in range(k):
            acc = mix(acc * U64(_BASE) + words[i : n - k + 1 + i])
        ok = doc[: n - k + 1] == doc[k - 1 :]
        out_h.append(acc[ok])
        out_d.append(doc[: n - k + 1][ok])
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        acc = np.full(len(short), 7, dtype=U64) * U64(_BASE)
        for i in range(k - 1):
            has = count[short] > i
            acc[has] = mix(acc[has] * U64(_BASE) + words[first[short[has]] + i] + U64(i))
        out_h.append(acc)
        out_d.append(short)
    if not out_h:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    h, d = np.concatenate(out_h), np.concatenate(out_d)
    if len(out_h) > 1:
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
    return h, d
