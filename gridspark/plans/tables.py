"""Where queries find their tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Tables = Callable[[str], DataFrame]
#: Runs SQL at a server: (connect string, SQL) to rows.
External = Callable[[str, str], DataFrame]


def parquet_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Tables by name (in any case) from Parquet files of one folder."""
    return lambda name: spark.read.parquet(f"{sf_dir}/{name.lower()}.parquet")


def linked_tables(own: Tables, links: dict[str, Callable[[], DataFrame]]) -> Tables:
    """`own` tables, but for the linked ones, whose names (in any case) have readers of their own."""
    readers = {name.casefold(): read for name, read in links.items()}
    return lambda name: readers[name.casefold()]() if name.casefold() in readers else own(name)


def jdbc(spark: SparkSession, options: Callable[[str], dict[str, str]]) -> External:
    """Pass-through SQL by JDBC; `options` turns a connect string into url, user and the like."""
    return lambda connect, sql: spark.read.format("jdbc").options(**options(connect)).option("query", sql.strip().rstrip(";")).load()


#: Rows that one task of `dealt` has at most, and those that are worth a task.
MOST_DEALT, LEAST_DEALT = 1_000, 50


def dealt(rows: DataFrame) -> DataFrame:
    """Small rows that each cost much work, dealt over tasks by their number: Spark makes one task of a file of few MB,
    whatever is done with its rows."""
    n = rows.count()
    several = min(3 * rows.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_DEALT))
    return rows.repartition(max(several, -(-n // MOST_DEALT), 1))


def bracketed(name: str) -> str:
    return f"`{name.replace('`', '``')}`"
