"""State that outlives one query: tables written to the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one where that setting is missing and the session runs on this
    machine alone. On a cluster a missing setting is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='stemma-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back, which cuts its lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """df with each row's place from 0 in this order: rows sorted by range over many files, then files' prefix sums plus
    the row's place in its file. No task sees more than its range."""
    path = shared_dir(df.sparkSession, "placed")
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    rows = df.sparkSession.read.schema(df.schema).parquet(path).withColumns({"_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")})
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("_file").agg(F.count("*").alias("_n")).select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(bases), "_file").withColumn(name, F.col("_base") + F.col("_row")).drop("_file", "_row", "_base")
