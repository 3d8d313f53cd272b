"""One-permutation MinHash fingerprints, in DataFrame functions only.

Each five-word shingle is hashed once; the hash's high part names a bin, its low
part is the value, and a bin keeps its least value. An empty bin takes over the
value of the first filled bin along a probe order of its own (optimal
densification: a universal hash per bin and attempt). Bins are stored as their
low `BITS` bits, one hexadecimal digit each, and likeness is corrected for
agreement by chance.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import free_names

BINS = 256
BITS = 4
WORDS = 5
#: Attempts by table; a bin still empty then ranks all filled bins by its universal hash.
PROBES = 12
_PRIME = 257
#: Bounds on what the search for the next document sends to the driver and holds in the plan.
MOST_BUCKETS, SAMPLED = 1 << 16, 8
#: A hash's top 8 bits (signed) name its bin, so sorted hashes lie bin by bin.
_SHIFT_BITS = 56
_EMPTY = (1 << _SHIFT_BITS) - 1

_rng = random.Random(20240229)
_PROBE = [[_rng.randrange(BINS) for _ in range(BINS)] for _ in range(PROBES)]
_SCALE = [_rng.randrange(1, _PRIME) for _ in range(BINS)]
_SHIFT = [_rng.randrange(_PRIME) for _ in range(BINS)]


def _table(values: list[int]) -> Column:
    return F.expr("array(" + ",".join(map(str, values)) + ")")


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds the fingerprint of `text` as the string column `name`.

    Texts are lower-cased and cut at white space (space, U+0009 to U+000D). Under
    five words the whole sequence is one shingle; so it is for null and empty
    texts, whose sequence is empty. Every step is a column of its own, as a step
    refers to the one before it from within lambdas.
    """
    h, bins, full = free_names(df.columns, f"{name}_hashes", f"{name}_bins", f"{name}_filled")
    keep = df.columns
    low = F.lower(F.coalesce(text, F.lit("")))
    parts = F.split(low, r"[\x20\x09-\x0D]+")  # has empty parts at the ends only
    white = [9, 10, 11, 12, 13, 32]
    ragged = (low == "") | F.ascii(low).isin(white) | F.ascii(F.right(low, F.lit(1))).isin(white)
    words = F.when(ragged, F.filter(parts, lambda w: w != "")).otherwise(parts)
    df = df.withColumn(h, F.transform(words, lambda w: F.xxhash64(w)))

    n = F.size(h) - (WORDS - 1)
    rolled = F.transform(F.slice(h, F.lit(1), F.greatest(n, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(F.col(h), i + k) for k in range(1, WORDS)]))
    shingles = F.when(n >= 1, rolled).otherwise(F.array(F.xxhash64(F.array_join(F.transform(F.col(h), lambda x: x.cast("string")), ","))))
    marks = F.expr("array(" + ",".join(f"{(b << _SHIFT_BITS) | _EMPTY}L" for b in range(-BINS // 2, BINS // 2)) + ")")
    df = df.withColumn(bins, F.sort_array(F.concat(shingles, marks)))

    first = F.filter(bins, lambda x, i: (i == 0) | (F.shiftright(x, _SHIFT_BITS) != F.shiftright(F.get(F.col(bins), i - 1), _SHIFT_BITS)))
    df = df.withColumn(bins, F.transform(first, lambda x: F.nullif(x.bitwiseAND(F.lit(_EMPTY)), F.lit(_EMPTY))))
    spare = F.filter(F.transform(bins, lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull())
    df = df.withColumn(full, F.when(F.exists(bins, lambda x: x.isNull()), spare))

    def value(x: Column, i: Column) -> Column:
        at = [F.get(F.col(bins), F.get(_table(p), i)) for p in _PROBE]
        rank = F.array_min(F.transform(F.col(full), lambda j: (j * F.get(_table(_SCALE), i) + F.get(_table(_SHIFT), i)) % _PRIME * BINS + j))
        return F.coalesce(x, *at, F.get(F.col(bins), rank % BINS))

    digit = F.expr("array('" + "','".join("0123456789abcdef") + "')")
    digits = F.transform(bins, lambda x, i: F.get(digit, value(x, i).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")))
    return df.withColumn(name, F.array_join(digits, "")).select(*keep, name)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two fingerprints: the share of equal bins, less that expected by chance."""
    other = F.lit(0)  # bins that differ, counted in words of 15 digits
    ones = F.lit(int("1" * 15, 16))
    for at in range(0, BINS, 15):
        x, y = (F.conv(F.substring(c, at + 1, 15), 16, 10).cast("long") for c in (a, b))
        x = x.bitwiseXOR(y)
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        other = other + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(ones))
    same = F.lit(BINS) - other
    chance = 1.0 / (1 << BITS)
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1.0 - chance)))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row; null texts count as empty, repeated rows stay."""
    return with_fingerprint(docs.select("doc_id", F.col("text").cast("string").alias("text")), F.col("text"), "fingerprint").select("doc_id", "fingerprint")


def _cuts(places: DataFrame, n: int, buckets: int) -> list[tuple[int, int]]:
    """Places that begin about `buckets` buckets of about equal size, the least place of all first.

    They come from a random sample of SAMPLED rows a bucket: it sets the sizes of
    buckets, not what is in them.
    """
    first = places.agg(F.min(F.struct("rank", "tie")).alias("p")).first().p
    share = min(1.0, SAMPLED * buckets / n)
    table = (places if share == 1.0 else places.sample(share, 7)).toPandas().sort_values(["rank", "tie"])
    picked = table.iloc[:: max(1, len(table) // buckets)]
    return sorted({(first.rank, first.tie), *zip(picked["rank"].tolist(), picked["tie"].tolist(), strict=True)})


def _longs(values: list[int]) -> Column:
    """One literal array, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def with_next(df: DataFrame, key: str, columns: list[str], per_bucket: int = 2000, prefix: str = "next_", tie_by: list[str] | None = None) -> DataFrame:
    """Adds the values that `columns` have in the next row by descending `key`; the last row gets the first one's.

    Rows are dealt out by ranges of (key, hash of `tie_by` or `columns`), at most MOST_BUCKETS,
    which a row finds by binary search; a range's first row goes to the range before
    it as well, so each range is a window of its own and no row is looked up. Rows of
    a null key come last; rows of equal keys follow each other by that hash, so that
    one key's rows split; rows equal in all of it stay together.
    """
    rank, tie, at, to, part, kind = free_names([*df.columns, *(prefix + c for c in columns)], "rank_of", "tie_of", "at_cut", "to_part", "part_of", "kind_of")
    null = (1 << 63) - 1
    df_places = df.withColumn(rank, F.coalesce(F.bitwise_not(F.col(key)), F.lit(null))).withColumn(tie, F.xxhash64(*(tie_by or columns)))  # ~key falls as key rises
    places = df_places.select(F.col(rank).alias("rank"), F.col(tie).alias("tie"))
    n = df.count()
    if not n:
        return df.select("*", *[F.col(c).alias(prefix + c) for c in columns])
    least = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = _cuts(places, n, max(1, min(n, MOST_BUCKETS, max(least, -(-n // per_bucket)))))
    ranks, ties = _longs([c[0] for c in cuts]), _longs([c[1] for c in cuts])
    jumps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
    reached = lambda i: (F.get(ranks, i) < F.col(rank)) | ((F.get(ranks, i) == F.col(rank)) & (F.get(ties, i) <= F.col(tie)))
    search = F.aggregate(jumps, F.lit(0), lambda low, jump: F.when((low + jump <= len(cuts)) & reached(low + jump - 1), low + jump).otherwise(low))
    rows = df_places.withColumn(at, search - 1)

    own = F.struct(F.col(at).alias("part"), F.lit(0).alias("kind"))
    before = F.struct(F.when(F.col(at) > 0, F.col(at) - 1).otherwise(len(cuts) - 1).alias("part"), F.when(F.col(at) > 0, 1).otherwise(2).alias("kind"))
    begins = (F.get(ranks, F.col(at)) == F.col(rank)) & (F.get(ties, F.col(at)) == F.col(tie))
    rows = rows.withColumn(to, F.explode(F.when(begins, F.array(own, before)).otherwise(F.array(own)))).withColumn(part, F.col(f"{to}.part")).withColumn(kind, F.col(f"{to}.kind"))
    window = Window.partitionBy(part).orderBy((F.col(kind) == 2).cast("int"), F.col(key).desc_nulls_last(), F.col(tie), F.col(kind))
    out = rows.select("*", *[F.lead(c).over(window).alias(prefix + c) for c in columns])
    return out.filter(F.col(kind) == 0).select(*df.columns, *[prefix + c for c in columns])


def compare_edited(docs: DataFrame) -> DataFrame:
    """The rows of the op9 contract: fingerprints of texts and of their edited texts.

    Null texts count as empty; a table of one row has itself as its next row.
    Rows of one doc_id follow each other by text; an empty table gives no row.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marked = with_fingerprint(base, F.col("text"), "fingerprint")
    pairs = with_next(marked, "doc_id", ["text", "fingerprint"], tie_by=["text"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    pairs = pairs.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    done = with_fingerprint(pairs, F.col("edited"), "edited_fingerprint")
    return done.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
