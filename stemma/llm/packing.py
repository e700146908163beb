"""Packing by power-of-two decomposition: pieces of binary lengths, equal lengths bucketed, no sequence across documents.

A document of n ids is cut, from its start, into as many full sequences as fit and then into one piece for each
binary digit of the rest, longest first. Every piece is a sequence of its own, of a power-of-two length: no
padding, and attention never crosses documents. Sequences are numbered without gaps, longest bucket first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytescan import give_back, slices
from .common import only, shared_dir, text_batches, written
from .encode import encoder
from .files import table

#: Bytes of text that a worker encodes at once, or one text. Fewer take less memory, and more time: each slice looks up its own distinct words.
SLICE_BYTES = 1 << 20
#: About 100 bytes each.
BROADCAST_ROWS = 500_000


def piece_lengths(n: int, longest: int) -> list[int]:
    """The lengths of a document's pieces, in order. longest is a power of two."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer: str, end_id: int, longest: int = 4096, path: str | None = None) -> DataFrame:
    """Pack docs(doc_id, text) and return the written sequences.

    Columns: doc_id, start, length, doc_tokens, ids (binary, little-endian unsigned 32 bits), sequence_id, offset
    (always 0). Null and empty texts are documents with the end id only; repeated rows are packed each on its own;
    an empty table has no sequence. Other columns are ignored. The pieces are written to the shared folder, each
    file in order of length, so the number of a sequence follows from counts per file and length alone: the ids
    are never shuffled.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest must be a power of two")
    text_batches(docs.sparkSession)
    spark, path = docs.sparkSession, path or shared_dir(docs.sparkSession, "packed")

    def cut(batches):
        enc, end = encoder(tokenizer, 4), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for rows in slices(batch, 1, SLICE_BYTES):
                who, start, length, total, ids = [], [], [], [], []
                for i, data in enumerate(enc.batch(rows.column(1))):
                    data += end
                    n = len(data) // 4
                    at = 0
                    for size in piece_lengths(n, longest):
                        who.append(i)
                        start.append(at)
                        length.append(size)
                        total.append(n)
                        ids.append(data[4 * at : 4 * (at + size)])
                        at += size
                yield table({"doc_id": rows.column(0).take(pa.array(who, pa.int64())), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "doc_tokens": pa.array(total, pa.int64()), "ids": pa.array(ids, pa.binary())})

        give_back()

    rows = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    pieces = rows.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, ids binary")
    pieces.sortWithinPartitions(F.desc("length")).write.option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(path)
    return numbered(spark.read.schema(pieces.schema).parquet(path))


def numbered(pieces: DataFrame) -> DataFrame:
    """Number written pieces: bucket by bucket, in each bucket file by file, in each file row by row.

    The bases, one per file and bucket, are broadcast up to BROADCAST_ROWS of them, so that the ids stay where they
    are; beyond that they are joined by shuffle.
    """
    placed = pieces.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    runs = placed.groupBy("length", "_file").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    buckets = runs.groupBy("length").agg(F.sum("_n").alias("_all"))
    longer = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("length", F.coalesce(F.sum("_all").over(longer), F.lit(0)).alias("_bucket"))
    before = Window.partitionBy("length").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.join(buckets, "length").select("length", "_file", (F.col("_bucket") + F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    bases = written(bases, "bases")
    small = bases.count() <= BROADCAST_ROWS
    out = placed.join(F.broadcast(bases) if small else bases, ["length", "_file"])
    return out.select("doc_id", "start", "length", "doc_tokens", "ids", (F.col("_base") + F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids, one row per piece."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = pack(docs, "word_bpe_49k.json", end_id=2)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
