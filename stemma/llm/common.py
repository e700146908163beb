"""Shared folder, written tables and row numbering used by the operators of this subpackage."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new, unique folder below spark.checkpoint.dir, which the driver and all executors share.

    Where that setting is missing, a temporary folder takes its place if the session runs on this machine alone (tests);
    on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='stemma-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """As written, with the folder, for discard."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    return stored(df, what, codec)[0]


def discard(spark: SparkSession, path: str) -> None:
    """Delete the folder of a stored table that nothing will read any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def only(df: DataFrame, *names: str) -> DataFrame:
    """df with just these columns; other columns, also ones whose names differ only in case, do no harm."""
    lower = [c.lower() for c in df.columns]
    for n in names:
        if df.columns.count(n) != 1:
            raise ValueError(f"column {n!r} occurs {df.columns.count(n)} times in {df.columns}")
    if any(lower.count(n.lower()) > 1 for n in names):
        df = df.toDF(*[c if c in names else f"__other_{i}" for i, c in enumerate(df.columns)])
    return df.select(*[F.col(f"`{n}`") for n in names])


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that nothing refers to any more, so they don't pile up on disk."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df, written in this order over many files, with each row's place from 0: files' prefix sums plus row in file."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, "ranked")
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("compression", "zstd").parquet(path)
    rows = spark.read.schema(df.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("_file").agg(F.count("*").alias("_n")).select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(bases, "_file").withColumn(name, F.col("_base") + F.col("_row")).drop("_file", "_row", "_base")


#: A key is hot with more than one part in PARTS of all rows, and with more than LIGHT rows.
PARTS, LIGHT = 1000, 1000


def hot_keys(counts: DataFrame, key: str) -> DataFrame:
    """counts(key, n), one row per key -> (key, _salts) of the hot keys, written: under PARTS rows, whatever the table."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = max(total / PARTS, LIGHT)
    hot = written(counts.where(F.col("n") > share).select(key, F.ceil(F.col("n") / share).cast("int").alias("_salts")), "hot")
    return F.broadcast(hot)


def heavy_join(rows: DataFrame, other: DataFrame, key: str, by: str, hot: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """rows joined with other on the column key (inner or left; a null key meets none), where one key may hold any share of rows.

    A hot key's rows are dealt over several tasks by the hash of column `by`, and other's rows of that key are copied to
    each. hot: hot_keys of rows, counted here where not given.
    """
    hot = hot_keys(rows.groupBy(key).agg(F.count("*").alias("n")), key) if hot is None else hot
    salted = rows.join(hot, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")
    copied = other.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    return salted.join(copied, [key, "_salt"], how).drop("_salt")


#: Rows of text in one Arrow batch: some 4 MB of usual documents, in the JVM's and in the worker's memory.
TEXT_ROWS = 1200


def text_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session be small where rows are whole texts; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > TEXT_ROWS or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, str(TEXT_ROWS))
