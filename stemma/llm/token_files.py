"""Token-ID output: flat files of unsigned integers with 64-bit document offsets, memory-mapped on reading.

Layout of a written set, one trio of files per partition, partitions in ascending doc_id order:

- part-NNNNN.ids   all ids of the partition's documents, back to back, little-endian unsigned 16 or 32 bits
- part-NNNNN.off   documents + 1 unsigned 64-bit offsets into it, in ids
- part-NNNNN.doc   the documents' doc_ids, signed 64 bits, with part-NNNNN.nul one byte each: 1 for a null doc_id

The manifest (a small Parquet table) holds partition, documents and ids of each; the place of a partition's first
id among all ids, its base, is the prefix sum of the ids of the partitions before it.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytescan import give_back, slices
from .common import only, shared_dir, text_batches
from .encode import encoder, width_of
from .files import AtomicFile, mapped, table

#: Bytes of text that a worker encodes at once (or one text), and documents that it reads at once.
SLICE_BYTES, SLICE = 1 << 22, 512


@dataclass(frozen=True)
class TokenFiles:
    """A written set: its folder and the bytes of an id."""

    path: str
    width: int


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None) -> TokenFiles:
    """Encode docs(doc_id long, text string) and write the set; every document gets end_id behind its ids.

    Null and empty texts have the end id only. Documents stand in ascending doc_id order, null doc_ids first and
    equal doc_ids by text. An empty table gives an empty set. Other columns are ignored.
    """
    spark = docs.sparkSession
    text_batches(spark)
    path, width = path or shared_dir(spark, "token-files"), width_of(tokenizer, end_id)

    def write(batches):
        task = TaskContext.get()
        part, end = f"{path}/part-{task.partitionId():05d}", np.array([end_id], f"<u{width}").tobytes()
        files, enc = None, encoder(tokenizer, width)
        at, ends, ids, nulls = 0, [0], [], []
        for batch in batches:
            for rows in slices(batch, 1, SLICE_BYTES):
                files = files or AtomicFile(f"{part}.ids", str(task.taskAttemptId()))
                for data in enc.batch(rows.column(1)):
                    at += len(data) // width + 1
                    ends.append(at)
                    files.write(data + end)
                ids.append(rows.column(0).fill_null(0).to_numpy(zero_copy_only=False))
                nulls.append(rows.column(0).is_null().to_numpy(zero_copy_only=False))
        give_back()
        if files is None:
            return
        files.commit()
        for kind, data in (("off", np.array(ends, "<u8")), ("doc", np.concatenate(ids).astype("<i8")), ("nul", np.concatenate(nulls).astype("u1"))):
            f = AtomicFile(f"{part}.{kind}", str(task.taskAttemptId()))
            f.write(data.tobytes())
            f.commit()
        yield table({"part": pa.array([task.partitionId()], pa.int32()), "n_docs": pa.array([len(ends) - 1], pa.int64()), "n_ids": pa.array([at], pa.int64())})

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    placed = rows.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    placed.mapInArrow(write, "part int, n_docs long, n_ids long").write.parquet(f"{path}/manifest")
    return TokenFiles(path, width)


def manifest(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """part, n_docs, n_ids and base (ids of all partitions before) of each partition: one row per file."""
    rows = spark.read.schema("part int, n_docs long, n_ids long").parquet(f"{files.path}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (binary, unsigned 32 bits) of each document."""
    path, dtype = files.path, f"<u{files.width}"

    def read(batches):
        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = f"{path}/part-{part:05d}"
                ids, off = mapped(f"{name}.ids", dtype), mapped(f"{name}.off", "<u8").astype("i8")
                doc, nul = mapped(f"{name}.doc", "<i8"), mapped(f"{name}.nul", "u1")
                for lo in range(0, len(doc), SLICE):
                    hi = min(lo + SLICE, len(doc))
                    yield table({
                        "doc_id": pa.array(np.asarray(doc[lo:hi]), pa.int64(), mask=np.asarray(nul[lo:hi]) == 1),
                        "start": pa.array(base + off[lo:hi]),
                        "n_tokens": pa.array(np.diff(off[lo : hi + 1])),
                        "ids": pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(off[lo:hi], off[lo + 1 : hi + 1], strict=True)], pa.binary()),
                    })

    parts = manifest(spark, files).select("part", "base")
    spread = parts.repartition(max(1, parts.count()), "part")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def crc32_of(data: bytes) -> int:
    """Unsigned CRC-32."""
    return zlib.crc32(data) & 0xFFFFFFFF


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, written in the file format and read back: place, count and checksum of each document's ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = write_token_files(docs, "byte_bpe_50k.json", end_id=2)
    return read_token_files(spark, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
