"""Phrase collocation mining.

Texts are cut into pieces and words; the n-grams of each order within pieces become rows
and are counted per language. An n-gram can be frequent only if both of its parts
of one word less are, so of each higher order only those rows are made whose parts lie
in a bit set of the frequent n-grams of the order before: the set has a fixed size, and a
part that it takes for frequent by mistake costs a row, not a result. Frequent phrases
join the counts of their parts, are scored in Decimal, and lose to a one-word extension.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textvec import Hasher, lower_ascii, mix, runs, slices, string_buffers
from .workspace import apart, remove, write_table

WORDS, LEAST, SHARE, FIRST = 3, 10, 50, 2000
#: The bit set of frequent n-grams has 2**FILTER_BITS bits, whatever the data.
FILTER_BITS = 27
_PART = 15
_SLICE = 500_000

_apart = np.zeros(256, dtype=bool)
_apart[[0x20, 9]] = True
_ends = np.zeros(256, dtype=bool)
_ends[[ord(c) for c in ".,;:!?"]] = _ends[[10, 11, 12, 13]] = True

_GRAMS = "lang string, gram string, n long"


class Words:
    """The words of some texts, side by side with one space between, and which of them follow each other in a piece."""

    def __init__(self, texts: pa.Array):
        raw, offs = string_buffers(texts)
        raw = lower_ascii(raw)
        inside = ~(_apart | _ends)[raw]
        start, end, doc = runs(inside, offs)
        length = end - start
        self.count = len(start)
        self.start = np.cumsum(length + 1) - length - 1
        self.end = self.start + length
        self.bytes = np.full(int(length.sum()) + self.count, 32, dtype=np.uint8)
        self.bytes[np.arange(int(length.sum())) + np.repeat(np.arange(self.count), length)] = raw[inside]
        cut = np.concatenate([[0], np.cumsum(_ends[raw])])
        self.follows = (doc[1:] == doc[:-1]) & (cut[start[1:]] == cut[end[:-1]]) if self.count else np.zeros(0, bool)

    def grams(self, n: int) -> np.ndarray:
        """The first words of all n-grams."""
        ok = np.ones(max(self.count - n + 1, 0), dtype=bool)
        for k in range(n - 1):
            ok &= self.follows[k : k + len(ok)]
        return np.flatnonzero(ok)

    def text(self, first: np.ndarray, n: int) -> pa.Array:
        start, size = self.start[first], self.end[first + n - 1] - self.start[first]
        offs = np.concatenate([[0], np.cumsum(size)])
        body = self.bytes[np.arange(offs[-1]) + np.repeat(start - offs[:-1], size)]
        return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(body))


def _bits(h: np.ndarray, lang: str, bits: int) -> np.ndarray:
    """The place in a set of 2**bits of each n-gram hash in one language."""
    raw = np.frombuffer(lang.encode(), dtype=np.uint8)
    own = Hasher(raw).ranges(np.array([0]), np.array([len(raw)]))
    return mix(h ^ own) >> np.uint64(64 - bits)


def _counter(n: int, shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (lang, gram, n) of the n-grams of each slice; of single words, and all words under an empty gram."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if shared is None else np.frombuffer(shared.value, dtype=np.uint8)
        for part in slices(batches, limit=_SLICE):
            langs = part.column(1)
            for lang in pc.unique(langs).to_pylist():
                words = Words(part.column(0).filter(pc.equal(langs, lang)))
                if not words.count:
                    continue
                first = words.grams(n)
                if known is not None and len(first):
                    hasher = Hasher(words.bytes)
                    for shift in (0, 1):
                        at = _bits(hasher.ranges(words.start[first + shift], words.end[first + shift + n - 2]), lang, len(known).bit_length() + 2)
                        first = first[(known[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                found = pc.value_counts(words.text(first, n))
                grams, counts = found.field("values").cast(pa.string()), found.field("counts")
                if n == 1:
                    grams, counts = pa.concat_arrays([grams, pa.array([""])]), pa.concat_arrays([counts, pa.array([words.count], pa.int64())])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), grams, counts], names=["lang", "gram", "n"])

    return work


def _frequent(grams: DataFrame) -> bytes:
    """The bit set of the given n-grams: at most 2**(FILTER_BITS - 3) bytes come to the driver."""

    bits = FILTER_BITS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text="gram"):
            langs = part.column(0)
            for lang in pc.unique(langs).to_pylist():
                raw, offs = string_buffers(part.column(1).filter(pc.equal(langs, lang)))
                at = np.unique(_bits(Hasher(raw).ranges(offs[:-1], offs[1:]), lang, bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at)], names=["at"])

    places = grams.filter("gram <> ''").select("lang", "gram").mapInArrow(work, "at long")
    rows = places.groupBy(F.shiftright("at", _PART).alias("part")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit((1 << _PART) - 1))).alias("bits"))
    out = bytearray(1 << (bits - 3))
    for row in rows.toLocalIterator():
        at = row.part << (_PART - 3)
        out[at : at + len(row.bits)] = row.bits
    return bytes(out)


def count_grams(docs: DataFrame, words: int = WORDS, least: int = LEAST) -> tuple[DataFrame, list[str]]:
    """(lang, gram, f, words) of the n-grams of 1 to `words` words that occur `least` times or more, and its tables' paths.

    The empty gram of a language has its number of words.
    """
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    tables, paths, shared = [], [], None
    for n in range(1, words + 1):
        counted = texts.mapInArrow(_counter(n, shared), _GRAMS).groupBy("lang", "gram").agg(F.sum("n").alias("f"))
        table, path = write_table(counted.filter((F.col("f") >= least) | (F.col("gram") == "")), f"phrases-{n}")
        if shared is not None:
            shared.destroy()
        shared = docs.sparkSession.sparkContext.broadcast(_frequent(table)) if n < words else None
        tables.append(table.withColumn("words", F.lit(n)))
        paths.append(path)
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out, paths


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly, for counts under 10**14."""
    a, left, right = (c.cast("decimal(14,0)") for c in (a, left, right))
    top = F.lit(1_000_000).cast("decimal(7,0)") * (a * a)
    return F.call_function("div", top, left * right)


def _scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of every phrase of two words or more: its lowest-scoring cut."""
    parts = F.split("gram", " ")
    phrases = counts.filter("words >= 2")
    cuts = phrases.select("lang", F.col("gram").alias("phrase"), "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"), parts.alias("parts"))
    cuts = cuts.select("lang", "phrase", "words", "a", "cut", F.array_join(F.slice("parts", F.lit(1), F.col("cut")), " ").alias("head"), F.array_join(F.slice("parts", F.col("cut") + 1, F.col("words") - F.col("cut")), " ").alias("tail"))
    known = counts.filter("gram <> ''")
    cuts = cuts.join(apart(known.select("lang", F.col("gram").alias("head"), F.col("f").alias("l"))), ["lang", "head"])
    cuts = cuts.join(apart(known.select("lang", F.col("gram").alias("tail"), F.col("f").alias("r"))), ["lang", "tail"])
    least = F.min(F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "cut", "l", "r")).alias("least")
    return cuts.groupBy("lang", "phrase", "words", "a").agg(least).select("lang", "phrase", "words", "a", "least.l", "least.r", "least.score")


def _extended(counts: DataFrame) -> DataFrame:
    """(lang, phrase, most): each phrase within a phrase of one word more, with the largest count of those."""
    parts = F.split("gram", " ")
    within = F.array(*[F.array_join(F.slice(parts, F.lit(s), F.col("words") - 1), " ") for s in (1, 2)])
    return counts.filter("words >= 3").select("lang", F.explode(within).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))


def mine_phrases(docs: DataFrame, words: int = WORDS, least: int = LEAST, share: int = SHARE, first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the op13 contract, over text and lang.

    Null texts count as empty, null languages as `und`; repeated rows count each time; a
    text without words adds nothing; an empty table gives no row. Other columns are not
    read. A phrase within a longer one of at least `share` percent of its count goes:
    then a phrase of one word more has that count, too, so only those are joined. Ties of
    the score are ranked by count, then by the phrase's bytes. A text is cut in one piece of memory.
    """
    counts, paths = count_grams(docs, words, least)
    scored = _scored(counts).join(_extended(counts).withColumnRenamed("most", "most_of"), ["lang", "phrase"], "left")
    scored, path = write_table(scored.filter(F.col("most_of").isNull() | (100 * F.col("most_of") < share * F.col("a"))), "phrases-scored")
    reached = F.sum("many").over(Window.partitionBy("lang").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    levels = scored.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("many")).withColumn("reached", reached)  # a million levels at most
    cut = levels.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("reached") >= first, F.col("score"))), F.min("score")).alias("cut"))
    cut, cut_path = write_table(cut, "phrases-cut")  # a row a language: small enough for Spark to see that, so phrases stay where they are
    high = scored.join(cut, "lang").filter("score >= cut")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    top = high.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= first)
    totals = counts.filter("gram = '' and words = 1").select("lang", F.col("f").alias("n"))
    out, _ = write_table(top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases")
    remove(docs.sparkSession, path, cut_path, *paths)
    return out
