"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under `spark.checkpoint.dir`; where that is unset, in a temporary folder of a local session, else it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="gridspark-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        folder = f"file://{_own[0]}"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """`df` written in the shared folder and read again: computed once, safe from lost executors. Rows lie apart `by`
    columns of few values, so that a filter on these reads no others."""
    path = shared_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
