"""JSON documents with sorted keys: rows as lines, or a file for each row that appears whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from gridspark.plans.tables import bracketed


def _sorted(value: Column, kind: DataType) -> Column:
    """`value` with the fields of its structs, and the keys of its maps, in the order of their names."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[_sorted(value[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _sorted(x, kind.elementType)) if isinstance(kind.elementType, (StructType, ArrayType, MapType)) else value
    if isinstance(kind, MapType):
        entries = F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        return F.map_from_entries(F.transform(entries, lambda e: F.struct(e["key"], _sorted(e["value"], kind.valueType).alias("value"))))
    return value


def json_of(df: DataFrame) -> Column:
    """The JSON of a row of `df`: keys sorted at every level, nulls kept."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    return F.to_json(F.struct(*[_sorted(F.col(bracketed(f.name)), f.dataType).alias(f.name) for f in fields]), {"ignoreNullFields": "false"})


def sorted_json(df: DataFrame) -> DataFrame:
    """(value) of every row's JSON."""
    return df.select(json_of(df).alias("value"))


def write_documents(df: DataFrame, folder: str, name: str, text: str) -> int:
    """Writes the column `text` of each row to `<name>.json` in `folder`; the number of documents.

    All documents are written aside by one Spark job first; each then takes its place by one
    rename, over an old one of its name. A job that fails leaves the folder as it was. Two rows of one
    name are an error. Names are URL-encoded.
    """
    spark = df.sparkSession
    rows = df.select(F.url_encode(F.col(name).cast("string")).alias("name"), F.col(text).alias("value")).filter("name is not null")
    twice = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"two documents are called {twice[0].name}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop, aside = jvm.org.apache.hadoop.fs, f"{folder.rstrip('/')}/.aside-{uuid.uuid4().hex}"
    fs = hadoop.Path(folder).getFileSystem(conf)
    try:
        rows.repartition("name").write.partitionBy("name").text(aside)
        context = hadoop.FileContext.getFileContext(fs.getUri(), conf)
        over = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        over[0] = getattr(hadoop, "Options$Rename").OVERWRITE
        count = 0
        for part in fs.globStatus(hadoop.Path(f"{aside}/name=*/part-*")):  # names, not contents
            path = part.getPath()
            encoded = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(path.getParent().getName().partition("=")[2])
            context.rename(path, hadoop.Path(folder, f"{encoded}.json"), over)
            count += 1
        return count
    finally:
        fs.delete(hadoop.Path(aside), True)
