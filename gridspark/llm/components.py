"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import join_counted, remove, write_table


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each vertex hands its larger neighbours the least of its neighbourhood."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("degree"))
    up = join_counted(both.filter(F.col("b") > F.col("a")), least, "a", "degree", 2 * total)
    return up.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Each vertex hands its smaller neighbours, and takes itself, the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree"))
    moved = join_counted(down, least, "a", "degree", total).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, name: str = "components", rounds: int = 40, paths: list[str] | None = None) -> DataFrame:
    """(vertex, component): the least vertex of each component, for all vertices with edges.

    `edges(a, b)` are pairs of longs. Only tables in the shared folder carry state
    from round to round, the last two at most, and only a count and a checksum come to
    the driver. A vertex of very many edges is joined by broadcast, so its edges do not
    meet in one task. The number of rounds grows with the logarithm of the size; it is
    an error to need more than `rounds`. The path of the last table, which the result
    reads, is added to `paths`.
    """
    sign = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    now, path = write_table(edges.filter("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct(), name)
    before = sign(now)
    for _ in range(rounds):
        if not before[0]:
            break
        half, half_path = write_table(_large_star(now, before[0]), name)
        now, new_path = write_table(_small_star(half, before[0]), name)
        remove(edges.sparkSession, path, half_path)
        path, after = new_path, sign(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    if paths is not None:
        paths.append(path)
    roots = now.select(F.col("b").alias("vertex")).distinct().withColumn("component", F.col("vertex"))
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(roots)
