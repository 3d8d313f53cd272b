"""Small helpers for choosing rows by a score or by a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096, few: int = 10_000) -> float | None:
    """The k-th largest of a numeric column, exactly: None for k < 1; the least value if there are under k.

    Each pass counts one histogram and goes on in the bin that holds the answer, so
    at most `bins` counts or `few` values come to the driver.
    """
    values = df.select(F.col(column).cast("double").alias("x")).filter(F.col("x").isNotNull())
    lo, hi, n = values.agg(F.min("x"), F.max("x"), F.count("x")).first()
    if k < 1 or not n:
        return None
    if k >= n:
        return lo
    while True:
        inside = values.filter((F.col("x") >= lo) & (F.col("x") <= hi))
        if lo == hi:
            return lo
        if n <= few:
            return sorted((r.x for r in inside.collect()), reverse=True)[k - 1]
        width = (hi - lo) / bins
        at = F.least(F.floor((F.col("x") - lo) / width), F.lit(bins - 1)).cast("int")
        rows = inside.groupBy(at.alias("at")).agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        for row in sorted(rows, key=lambda r: -r.at):
            if k <= row.n:
                lo, hi, n = row.lo, row.hi, row.n
                break
            k -= row.n


def fold(key: Column, folds: int) -> Column:
    """crc32 of a key as text, modulo `folds`; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def sample_ids(rows: DataFrame, key: str, bound: int) -> list[int]:
    """Up to `bound` distinct keys of `rows`, those of the least hash: the same ones at every run."""
    spread = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.first(F.xxhash64(key)).alias("spread_by"))
    return [r[key] for r in spread.orderBy("spread_by", key).limit(bound).collect()]


def only_ids(df: DataFrame, key: str, ids: list[int]) -> DataFrame:
    """The rows whose key is one of `ids`, a list of bounded length (that of a training sample)."""
    wanted = df.sparkSession.createDataFrame([(int(i),) for i in ids], "wanted_id long")
    return df.join(F.broadcast(wanted), F.col(key) == F.col("wanted_id"), "left_semi")
