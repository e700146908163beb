"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Words and pairs of words fall into SLOTS slots by hash. The target model is of the labelled good documents, the raw
model of all documents; a document's log weight is the sum of log(target / raw) over its n-grams. Adding Gumbel noise
to log weights and taking the k largest draws k documents without replacement in proportion to their weights. The
noise is a function of doc_id and seed, so a retried task draws the same. The k-th largest is found by numbering
rows sorted over many partitions, never in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import NOT_SPACE, BASES, lowered, mix, range_hashes, slices, texts_of, words_of
from .common import heavy_join, only, ranked, text_batches, written
from .files import table

SLOT_BITS = 16
SLOTS = 1 << SLOT_BITS
#: Good ids, of some 30 bytes each, that are broadcast; more are joined by shuffle.
BROADCAST_IDS = 500_000


def ngrams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot and text number of each word and each pair of neighbouring words."""
    buf = lowered(buf)
    start, end, doc = words_of(buf, off, NOT_SPACE)
    h = range_hashes(buf, start, end, BASES[0])
    two = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.empty(0, np.int64)
    pairs = mix(h[two] * np.uint64(0x9DDFEA08EB382D69) + h[two + 1])
    slot = np.concatenate([h, pairs]) >> np.uint64(64 - SLOT_BITS)
    return slot.astype(np.int64), np.concatenate([doc, doc[two]])


def _count(batches):
    """Arrow function (good, text) -> (slot, target, raw) of the partition."""
    raw, target = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
    for batch in batches:
        for part in slices(batch, 1):
            slot, doc = ngrams(*texts_of(part.column(1)))
            good = part.column(0).to_numpy(zero_copy_only=False).astype(bool)
            raw += np.bincount(slot, minlength=SLOTS)
            target += np.bincount(slot[good[doc]], minlength=SLOTS)
    used = np.flatnonzero(raw)
    yield table({"slot": pa.array(used.astype(np.int32)), "target": pa.array(target[used]), "raw": pa.array(raw[used])})


def log_ratios(rows: DataFrame, smooth: float) -> np.ndarray:
    """log(target / raw) of each slot, from all rows(good, text): SLOTS numbers, however large the corpus."""
    got = rows.mapInArrow(_count, "slot int, target long, raw long").groupBy("slot").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw")).toArrow()
    both = np.zeros((2, SLOTS))
    for i, c in enumerate(("target", "raw")):
        both[i, got["slot"].to_numpy()] = got[c].to_numpy()
    # both are smoothed towards the raw distribution, so a slot that the target never saw isn't ruled out
    raw = both[1] + 1
    raw /= raw.sum()
    target = (both[0] + smooth * raw) / (both[0].sum() + smooth)
    return (np.log(target) - np.log(raw)).astype(np.float32)


def _weigh(ratios):
    """Arrow function (doc_id, text, u) -> doc_id, n_ngrams, log_weight."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                slot, doc = ngrams(*texts_of(part.column(1)))
                n = np.bincount(doc, minlength=part.num_rows)
                w = np.bincount(doc, weights=ratios.value[slot], minlength=part.num_rows)
                yield table({"doc_id": part.column(0), "n_ngrams": pa.array(n.astype(np.int64)), "log_weight": pa.array(np.round(w, 6))})

    return run


def resampled(docs: DataFrame, labels: DataFrame, share: float | None = None, smooth: float = 1000.0, seed: int = 7) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, quality) -> doc_id, n_ngrams, log_weight, key and kept: one row per row.

    kept marks the k rows of largest key, k being `share` of all rows, by default the share of good labels (all where
    there are no labels). A doc_id is good when any of its labels has quality 1; null doc_ids are never good. Null, empty
    and blank texts have no n-grams and weight 0. Repeated rows are each weighed and share their noise; ties in key
    go to the lesser doc_id, null first. An empty table gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    text_batches(spark)
    docs = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    marks = only(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"))
    marks = written(marks, "marks")
    rate, n_good = marks.agg(F.avg("good"), F.coalesce(F.sum("good"), F.lit(0))).first()
    share = share if share is not None else 1.0 if rate is None else float(rate)
    good = marks.where("good = 1")
    good = docs.join(F.broadcast(good), "doc_id", "left") if n_good <= BROADCAST_IDS else heavy_join(docs, good.hint("merge"), "doc_id", "text", how="left")
    good = good.select(F.coalesce("good", F.lit(0)).alias("good"), "text")
    ratios = spark.sparkContext.broadcast(log_ratios(good, smooth))
    weighed = docs.mapInArrow(_weigh(ratios), "doc_id long, n_ngrams long, log_weight double")
    u = (F.shiftrightunsigned(F.xxhash64(F.coalesce("doc_id", F.lit(-1).cast("long")), F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = weighed.withColumn("key", F.col("log_weight") - F.ln(-F.ln(u)))
    numbered = ranked(keyed, [F.desc("key"), F.asc_nulls_first("doc_id")], "place")
    n = numbered.count()
    return numbered.select("doc_id", "n_ngrams", "log_weight", "key", (F.col("place") < round(share * n)).alias("kept"))


def op7_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log weight of every document and whether it is drawn."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return resampled(docs, labels)
