"""Byte-level BPE ids of whole documents, by distinct pre-token.

The pre-token rule of the vocabulary (letters, digits, other characters, white
space, contractions) is evaluated over whole code-point buffers; each distinct
pre-token of a task is encoded once and kept in a cache of bounded size. Ids
equal those of encoding each document by itself with the `tokenizers` library.
"""

from __future__ import annotations

import base64
import functools
import os
import unicodedata

import numpy as np
import pyarrow as pa

from .textvec import Hasher, code_points, string_buffers

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: The contractions of the pre-token rule.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
SPECIAL = "<|endoftext|>"
CACHE_ENTRIES = 1_000_000
_WHITE = {9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, *range(0x2000, 0x200B)}


def _class(cp: int) -> int:
    if cp in _WHITE:
        return SPACE
    kind = unicodedata.category(chr(cp))[0]
    return LETTER if kind == "L" else NUMBER if kind == "N" else OTHER


@functools.cache
def _page(page: int) -> np.ndarray:
    return np.array([_class(cp) for cp in range(page << 8, (page + 1) << 8)], dtype=np.uint8)


def classes(codes: np.ndarray) -> np.ndarray:
    """The class of each code point; tables are made for the pages that occur."""
    out = _page(0)[np.minimum(codes, 255)]
    high = np.flatnonzero(codes > 255)
    if len(high):
        pages = codes[high] >> 8
        for page in np.unique(pages).tolist():
            at = high[pages == page]
            out[at] = _page(page)[codes[at] & 255]
    return out


def pre_tokens(codes: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Start of each pre-token, in code points; they tile the buffer."""
    n = len(codes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = classes(codes)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    new = np.ones(n, dtype=bool)
    new[1:] = (kind[1:] != kind[:-1]) | edge[1:n]
    last_space = np.zeros(n, dtype=bool)  # white space with text after it, in the same document
    last_space[:-1] = (kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~edge[1:n]
    start = new | last_space  # the last white space of a run stands alone or joins what follows
    joins = last_space & (codes == 32)
    follows = np.zeros(n, dtype=bool)
    follows[1:] = joins[:-1]
    start &= ~follows
    alone = np.flatnonzero(new & (codes == 39) & ~follows)  # an apostrophe that begins a pre-token
    if len(alone):
        padded = np.concatenate([codes, np.zeros(3, np.uint32)])
        near = np.concatenate([edge, np.ones(3, bool)])
        for word in CONTRACTIONS:
            hit = np.ones(len(alone), dtype=bool)
            for i, c in enumerate(word, 1):
                hit &= (padded[alone + i] == ord(c)) & ~near[alone + i]
            at = alone[hit]
            start[at + 1] = False
            end = at + len(word) + 1
            end = end[(end < n)]
            letter = kind[np.minimum(end, n - 1)] == LETTER
            start[end[letter]] = True
            alone = alone[~hit]
    return np.flatnonzero(start)


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def _encoders(path: str):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    table = os.path.splitext(path)[0] + ".tiktoken"
    fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(table), special_tokens={})
    return fast, Tokenizer.from_file(path)


@functools.cache
def shared_tokenizer(path: str) -> DocumentTokenizer:
    """One tokenizer a Python worker, so that later tasks find its pre-tokens known."""
    return DocumentTokenizer(path)


class DocumentTokenizer:
    """Encodes string columns. `path`: the vocabulary for `tokenizers`, with the same ranks beside it."""

    def __init__(self, path: str):
        self.fast, self.full = _encoders(path)
        self.known = np.zeros(0, dtype=np.uint64)
        self.first = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _learn(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: str) -> None:
        new = [self.fast.encode_ordinary(text[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        count = np.fromiter(map(len, new), dtype=np.int64, count=len(new))
        flat = np.fromiter((i for x in new for i in x), dtype=np.uint32, count=int(count.sum()))
        first = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, flat])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known)
        self.known = known[order]
        self.first = np.concatenate([self.first, first])[order]
        self.count = np.concatenate([self.count, count])[order]

    def _forget(self) -> None:
        self.known, self.first, self.count, self.ids = self.known[:0], self.first[:0], self.count[:0], self.ids[:0]

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text; null counts as empty."""
        raw, offs = string_buffers(column)
        codes, at = code_points(raw, offs)
        n_docs = len(at) - 1
        start = pre_tokens(codes, at)
        end = np.append(start[1:], len(codes)).astype(np.int64)
        text = codes.tobytes().decode("utf-32-le")
        h = Hasher(codes).ranges(start, end)
        distinct, index, inverse = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.known, distinct)
        there = place < len(self.known)
        there[there] = self.known[place[there]] == distinct[there]
        if not there.all():
            if len(self.known) > CACHE_ENTRIES:
                self._forget()
                there[:] = False
            self._learn(distinct[~there], start[index[~there]], end[index[~there]], text)
            place = np.searchsorted(self.known, distinct)
        place = place[inverse]
        count = self.count[place]
        total = np.concatenate([[0], np.cumsum(count)])
        source = np.repeat(self.first[place] - total[:-1], count) + np.arange(total[-1])
        ids = self.ids[source]
        bounds = total[np.searchsorted(start, at)]
        out = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        if SPECIAL in text:
            for i in range(n_docs):
                doc = text[at[i] : at[i + 1]]
                if SPECIAL in doc:
                    out[i] = np.array(self.full.encode(doc, add_special_tokens=False).ids, dtype=np.uint32)
        return out
