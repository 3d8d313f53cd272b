"""Where operators keep tables that cut lineage, and joins whose hot keys do not meet in one task."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when more than one in HOT of all rows have it, so there are under HOT hot keys whatever the data.
HOT = 1000
#: Keys of fewer rows than this are never hot.
HOT_ROWS = 50

_fallback: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; where that is unset, a temporary folder of a local session, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="gridspark-"))
        atexit.register(shutil.rmtree, _fallback[0], ignore_errors=True)
    return f"file://{_fallback[0]}"


#: Paths given out in this session and not deleted since.
_given: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _given.add(path)
    return path


def clean(spark: SparkSession) -> None:
    """Deletes all tables of this session that are still there: those that results read, when these are used up."""
    remove(spark, *_given)


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`df` as a table in the shared folder, and its path: computed once, safe from lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    return write_table(df, name)[0]


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that nothing reads any more."""
    for path in list(paths):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _given.difference_update(paths)


def apart(df: DataFrame) -> DataFrame:
    """`df` dealt anew, so that a join takes it as a side of its own: an aggregate's output keeps the
    aggregate's partitioning, and Spark splits a hot key only where it shuffles both sides for the join."""
    return df.repartition(max(1, df.sparkSession.sparkContext.defaultParallelism))


def join_counted(rows: DataFrame, values: DataFrame, key: str | list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """`rows` joined on `key` with `values`, which has a row for each key and in `count` its number of `rows`.

    Keys with over one in HOT of the `total` rows are under HOT in number: their
    values are read first and broadcast, and their rows stay where they are. The rest
    is shuffled. `how` is inner or left; `count` is not among the columns of the result.
    """
    keys = [key] if isinstance(key, str) else key
    hot, plain = F.col(count) > max(total // HOT, HOT_ROWS), values.drop(count)
    found = values.filter(hot).drop(count).collect()
    if not found:
        return rows.join(apart(plain), key, how)
    many = F.broadcast(rows.sparkSession.createDataFrame(found, plain.schema))
    few = rows.join(F.broadcast(many.select(*keys)), key, "left_anti")
    return rows.join(many, key).unionByName(few.join(apart(values.filter(~hot).drop(count)), key, how))


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, lengthened until none is among `columns` (case ignored)."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
