"""Suffix-array dedup of long repeated byte strings, by distributed prefix doubling on sampled positions.

Two positions share a string of `length` bytes when their suffixes have the same rank at that depth. Prefix
doubling gets ranks of depth 2h from pairs (rank of depth h at p, rank of depth h at p + h): Spark sorts the pairs,
each run of equal pairs is a new rank, and a suffix alone in its run is unique and leaves. Doubling from single bytes
would carry a row per byte through each round, so positions that can't matter leave before the first:

1. Every window of `length` bytes names one position in it, the least of its `seed`-byte fingerprints, so equal
   windows name the same place in themselves. Windows that name one place form a stretch. Spark sorts the rows
   (fingerprint of the named place, fingerprint of the stretch, position): a fingerprint that is unique ends its
   windows; of equal stretches all but the first repeat an earlier one as a whole.
2. A first stretch whose named place occurs in other stretches too may repeat in part. Its windows go one by one
   through the rounds of doubling, at offsets of a quarter and half of `length`: a row holds the rank of the depth
   reached so far, which the sort before assigned, and the ranks of the stretches of text still to come. A window
   alone in its run leaves; after the last round every window but the earliest of its run repeats.

Rows are placed by range over key and position, so a frequent string spreads over many partitions. A run that
touches a partition's end is judged by grouped aggregation instead; nothing is dropped, capped or collected. A table
that the next one replaces is deleted once that is written, and the rounds take half of the windows at a time, so
the disk holds one round of one half.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytescan import BASES, NARROW, hashes_at, minimizers, range_hashes, slices, texts_of, window_hashes
from .common import discard, only, release, shared_dir, stored, text_batches, written
from .files import table, tables

DUP, PART, OPEN, MARK = 0, 1, 2, 3
#: The rounds take the windows in so many shares, one after the other, by the first rank: equal windows are in one share.
SHARES = 2


def placed(docs: DataFrame) -> tuple[DataFrame, int]:
    """docs(doc_id, text) with `ord`, a long that keeps the order of doc_id, and the bits left for a byte position.

    Where doc_ids are distinct, not null and of a small range, ord is doc_id less the least one. Otherwise rows are
    numbered by (doc_id, text digest): null first, rows alike in both share a number and don't repeat each other.
    """
    seen = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("doc_id").alias("n"), F.count("*").alias("rows"), F.max(F.octet_length("text")).alias("longest")).first()
    if not seen.rows:
        return docs.withColumn("ord", F.lit(0).cast("long")), 31
    bits = max(1, int(seen.longest or 0).bit_length())
    twice = seen.n < seen.rows or docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not twice and (seen.hi - seen.lo + 1) << bits < 1 << 63:
        return docs.withColumn("ord", F.col("doc_id") - F.lit(seen.lo).cast("long")), bits
    keyed = docs.withColumn("_digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    keys = keyed.select("doc_id", "_digest").distinct().repartitionByRange("doc_id", "_digest").sortWithinPartitions("doc_id", "_digest")
    path = shared_dir(docs.sparkSession, "order")
    keys.write.parquet(path)
    rows = docs.sparkSession.read.schema(keys.schema).parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = rows.groupBy("_file").count().withColumn("_base", F.coalesce(F.sum("count").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    keys = rows.join(sizes, "_file").select(F.col("doc_id").alias("_id"), F.col("_digest").alias("_d"), (F.col("_base") + F.col("_row")).alias("ord"))
    joined = keyed.join(keys, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_d")))
    return joined.select(*docs.columns, "ord"), bits


def _windows(buf: np.ndarray, off: np.ndarray, length: int) -> np.ndarray:
    """The starts of all windows that lie within one text."""
    n = len(buf) - length + 1
    if n <= 0:
        return np.empty(0, np.int64)
    ok = np.ones(n, bool)
    for e in off[1:-1]:
        ok[max(0, e - length + 1) : e] = False
    return np.flatnonzero(ok)


def stretches(length: int, seed: int, bits: int):
    """Arrow function (ord, text) -> a row (a, b, pos, n) per stretch of n windows from pos."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, NARROW):
                buf, off = texts_of(part.column(1))
                j = _windows(buf, off, length)
                if not len(j):
                    continue
                at = window_hashes(buf, seed, BASES[0])
                named = minimizers(at, length - seed + 1)[j]
                first = np.flatnonzero(np.r_[True, (named[1:] != named[:-1]) | (j[1:] != j[:-1] + 1)])
                last = np.r_[first[1:], len(j)] - 1
                doc = np.searchsorted(off, j[first], "right") - 1
                start = part.column(0).to_numpy(zero_copy_only=False)[doc].astype(np.int64)
                yield from tables({
                    "a": pa.array(at[named[first]].view(np.int64)),
                    "b": pa.array(range_hashes(buf, j[first], j[last] + length, BASES[1]).view(np.int64)),
                    "pos": pa.array((start << bits) | (j[first] - off[doc])),
                    "n": pa.array((j[last] - j[first] + 1).astype(np.int32)),
                })

    return run


def depths(length: int) -> list[int]:
    """Where the rounds of doubling stand: a quarter, half and all of the length."""
    return [length // 4, length // 2, length]


def ranks(length: int, bits: int, share: int):
    """Arrow function (ord, text, parts: array of (start, n)) -> a row (a, b, pos, c) for each window of the parts
    that is in the share: the first ranks of the window and, for each round, of what it adds."""
    cuts = depths(length)

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, NARROW):
                buf, off = texts_of(part.column(1))
                parts = part.column(2)
                runs = parts.flatten()
                doc = np.repeat(np.arange(part.num_rows), np.array(pa.compute.list_value_length(parts)))
                n = runs.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
                start = runs.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                j, doc = np.repeat(start, n) + inside, np.repeat(doc, n)
                if not len(j):
                    continue
                order = np.argsort(off[doc] + j)
                j, doc = j[order], doc[order]
                first = hashes_at(buf, off[doc] + j, cuts[0])
                mine = np.flatnonzero(first % np.uint64(SHARES) == share)
                j, doc = j[mine], doc[mine]
                at = off[doc] + j
                which = part.column(0).to_numpy(zero_copy_only=False)[doc].astype(np.int64)
                found = [pa.array(hashes_at(buf, at + lo, hi - lo).view(np.int64)) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
                yield from tables({"a": pa.array(first[mine].view(np.int64)), "b": found[0], "pos": pa.array((which << bits) | j), "c": found[1]})

    return run


def _reranked(batches):
    """Arrow function over sorted (a, b, pos, ...): (kind, rank, a, b, pos, ...), rank being the first pos of a run of
    equal (a, b), and a and b null where the rank is final. Runs of one row leave.

    Rows stream through; only the first row of the run at hand waits. The partition's first run may have begun before
    it, so all its rows are OPEN; its last may go on, so it leaves its first row OPEN if alone, else a MARK of its rank.
    """
    run = None  # of the run at hand: (a, b), rank, its first row while it waits, whether it is the partition's first
    for batch in batches:
        if not batch.num_rows:
            continue
        names, rows = batch.schema.names, [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        a, b, pos = rows[:3]
        begins = np.r_[run is None or (a[0], b[0]) != run[0], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        at = np.flatnonzero(begins)
        on = int(at[0]) if len(at) else len(a)
        if on:  # the run at hand goes on
            if run[2] is not None:
                yield _ranked_rows(names, [x[None] for x in run[2]], PART, run[1])
            yield _ranked_rows(names, [x[:on] for x in rows], OPEN if run[3] else PART, run[1])
            run = (*run[:2], None, run[3])
        if run is None:
            end = int(at[1]) if len(at) > 1 else len(a)
            yield _ranked_rows(names, [x[:end] for x in rows], OPEN, pos[0])
            run, at = ((a[0], b[0]), pos[0], None, True), at[1:]
        if len(at):
            size = np.diff(np.r_[at, len(a)])
            last, alone = int(at[-1]), size[-1] == 1
            keep = np.zeros(len(a), bool)
            keep[at[0] :] = np.repeat(size > 1, size)
            yield _ranked_rows(names, [x[keep] for x in rows], PART, np.repeat(pos[at], size)[keep[at[0] :]])
            run = ((a[last], b[last]), pos[last], [x[last] for x in rows] if alone else None, False)
    if run and not run[3]:
        row = run[2] or [*run[0], run[1], *[np.int64(0)] * (len(names) - 3)]
        yield _ranked_rows(names, [x[None] for x in row], OPEN if run[2] else MARK, run[1])


def _ranked_rows(names: list[str], rows: list[np.ndarray], kind: int, rank: np.ndarray) -> pa.RecordBatch:
    n = len(rows[0])
    columns = {c: pa.nulls(n, pa.int64()) if kind == PART and c in "ab" else pa.array(x) for c, x in zip(names, rows, strict=True)}
    return table({"kind": pa.array(np.full(n, kind, np.int8)), "rank": pa.array(np.broadcast_to(rank, n).copy()), **columns})


def _doubled(rows: DataFrame) -> tuple[DataFrame, str]:
    """As doubled, with the folder of what was written."""
    rest = rows.columns[3:]
    ordered = rows.repartitionByRange("a", "b", "pos").sortWithinPartitions("a", "b", "pos")
    found, path = stored(ordered.mapInArrow(_reranked, ", ".join(["kind byte", *[f"{c} long" for c in ("rank", "a", "b", "pos", *rest)]])), "ranks")
    ends = found.where(F.col("kind").isin(OPEN, MARK))
    # the runs at a partition's ends are two at most in each: few keys, whatever the rows
    first = ends.groupBy("a", "b").agg(F.min("pos").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    late = ends.where(F.col("kind") == OPEN).join(F.broadcast(first), ["a", "b"]).select(F.col("least").alias("rank"), "pos", *rest)
    return found.where(F.col("kind") == PART).select("rank", "pos", *rest).unionByName(late), path


def doubled(rows: DataFrame) -> DataFrame:
    """One round of doubling. rows(a, b, pos, ...), all long -> (rank, pos, ...): rank of (a, b), unique ones left out;
    written."""
    return _doubled(rows)[0]


def _judge(rows: list[np.ndarray]) -> dict[int, list[np.ndarray]]:
    """Sorted whole runs of equal a -> rows that repeat an earlier one, and first rows of runs with several b."""
    a, b, pos, n = rows
    if not len(a):
        return {}
    new_a = np.r_[True, a[1:] != a[:-1]]
    new_b = new_a | np.r_[True, b[1:] != b[:-1]]
    run, cls = np.cumsum(new_a) - 1, np.cumsum(new_b) - 1
    several = np.bincount(run[new_b])[run] > 1
    dup = pos > pos[new_b][cls]
    return {DUP: [x[dup] for x in rows], PART: [x[new_b & several] for x in rows]}


def _at_end(rows: list[np.ndarray]) -> dict[int, list[np.ndarray]]:
    """A run that touches a partition's end: rows that repeat one before them in it; the first of each b stays open."""
    _, b, pos, _ = rows
    new_b = np.r_[True, b[1:] != b[:-1]]
    dup = pos > pos[new_b][np.cumsum(new_b) - 1]
    return {DUP: [x[dup] for x in rows], OPEN: [x[new_b] for x in rows]}


def _runs(batches):
    """Arrow function over sorted (a, b, pos, n): judged rows, with a and b null, and what stays open in runs at the
    partition's ends."""

    def out(kind, rows):
        keys = [pa.array(x) if kind == OPEN else pa.nulls(len(x), pa.int64()) for x in rows[:2]]
        return table({"kind": pa.array(np.full(len(rows[0]), kind, np.int8)), "a": keys[0], "b": keys[1], "pos": pa.array(rows[2]), "n": pa.array(rows[3])})

    held: list[list[np.ndarray]] = []  # the rows of the last run so far
    first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held and held[-1][0][-1] == rows[0][-1]:
            held.append(rows)
            continue
        last = int(np.searchsorted(rows[0], rows[0][-1], "left"))
        whole = [np.concatenate(x) for x in zip(*held, [x[:last] for x in rows], strict=True)]
        held = [[x[last:] for x in rows]]
        if first and len(whole[0]):
            cut = int(np.searchsorted(whole[0], whole[0][0], "right"))
            for kind, done in _at_end([x[:cut] for x in whole]).items():
                yield out(kind, done)
            whole, first = [x[cut:] for x in whole], False
        for kind, done in _judge(whole).items():
            yield out(kind, done)
    if held:
        for kind, done in _at_end([np.concatenate(x) for x in zip(*held, strict=True)]).items():
            yield out(kind, done)


def repeats(rows: DataFrame) -> tuple[DataFrame, str]:
    """rows(a, b, pos, n) -> (kind, pos, n), and the folder of what was written for it: DUP repeats an earlier row alike in
    a and b; PART is the first of its like where other rows with its a differ in b."""
    ordered = rows.repartitionByRange("a", "b", "pos").sortWithinPartitions("a", "b", "pos")
    judged, path = stored(ordered.mapInArrow(_runs, "kind byte, a long, b long, pos long, n int"), "runs")
    open_rows = judged.where(F.col("kind") == OPEN)
    like = open_rows.groupBy("a", "b").agg(F.min("pos").alias("least"))
    some = like.groupBy("a").agg((F.min("b") != F.max("b")).alias("several"))
    # two runs at most are open in each partition: few keys, whatever the rows
    joined = open_rows.join(like, ["a", "b"]).join(F.broadcast(some), "a")
    is_dup = F.col("pos") > F.col("least")
    late = joined.where(is_dup | F.col("several")).select(F.when(is_dup, DUP).otherwise(PART).cast("byte").alias("kind"), "pos", "n")
    return judged.where(F.col("kind") != OPEN).select("kind", "pos", "n").unionByName(late), path


def _united(length: int):
    """Arrow function over (pos, n) sorted by pos -> the same bytes by as few rows: windows that overlap or touch become one
    run. A run never reaches the next text, whose positions begin beyond this one's end."""

    def run(batches):
        held = (np.empty(0, np.int64),) * 2  # the start and the end, in bytes, of the run at hand
        for batch in batches:
            if not batch.num_rows:
                continue
            pos, n = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            starts = np.concatenate([held[0], pos])
            ends = np.maximum.accumulate(np.concatenate([held[1], pos + n - 1 + length]))
            first = np.flatnonzero(np.r_[True, starts[1:] > ends[:-1]])
            last = np.r_[first[1:], len(starts)] - 1
            yield runs(starts[first[:-1]], ends[last[:-1]])
            held = starts[first[-1:]], ends[last[-1:]]
        yield runs(*held)

    def runs(starts, ends):
        return table({"pos": pa.array(starts), "n": pa.array((ends - starts - length + 1).astype(np.int32))})

    return run


def united(rows: DataFrame, length: int) -> DataFrame:
    """rows(pos, n) of windows to remove -> (pos, n), one row for each run of them but for those that partitions part: a text
    then brings a few spans and not one for each of its windows."""
    return rows.repartitionByRange("pos").sortWithinPartitions("pos").mapInArrow(_united(length), "pos long, n int")


def _by_text(rows: DataFrame, bits: int, to: str) -> DataFrame:
    """(pos, n) gathered by ord: array of (start, n)."""
    start = F.col("pos").bitwiseAND(F.lit((1 << bits) - 1).cast("long")).alias("start")
    return rows.groupBy(F.shiftright("pos", bits).alias("ord")).agg(F.collect_list(F.struct(start, "n")).alias(to))


def removed_spans(docs: DataFrame, length: int = 100, seed: int = 50, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text) with `spans`: the bytes to remove, as an array of (start, end), and the columns to carry.

    A byte is removed when a string of `length` bytes that covers it also starts earlier: in a row of smaller doc_id
    or before in the same text. Strings are judged on the input; a text is its UTF-8 bytes; null counts as empty and
    stays null; texts shorter than `length` lose nothing. Null doc_ids come first; rows with the same doc_id and text
    count as one place and don't repeat each other; rows with the same doc_id and other texts come in the order of
    their digest. An empty table gives an empty table. Other columns are ignored.
    """
    text_batches(docs.sparkSession)
    docs, bits = placed(only(docs, "doc_id", "text", *carry).withColumn("doc_id", F.col("doc_id").cast("long")))
    texts = docs.where(F.octet_length("text") >= length).select("ord", "text")
    found, runs = repeats(texts.mapInArrow(stretches(length, seed, bits), "a long, b long, pos long, n int"))
    found = written(found, "stretches")
    discard(docs.sparkSession, runs)
    release(docs.sparkSession)
    parts = _by_text(found.where(F.col("kind") == PART), bits, "parts")
    again = reduce(DataFrame.unionByName, [_rounds(texts, parts, length, bits, share) for share in range(SHARES)])
    gone = _by_text(united(found.where(F.col("kind") == DUP).select("pos", "n").unionByName(again), length), bits, "gone")
    joined = docs.join(gone, "ord", "left")
    return joined.select("doc_id", "text", spans_of("gone", length).alias("spans"), *carry)


def _rounds(texts: DataFrame, parts: DataFrame, length: int, bits: int, share: int) -> DataFrame:
    """The rounds of doubling over one share of the windows of the parts -> (pos, n = 1) of those that repeat an earlier one."""
    spark = texts.sparkSession
    rows = texts.join(parts, "ord").select("ord", "text", "parts").mapInArrow(ranks(length, bits, share), "a long, b long, pos long, c long")
    halves, path = _doubled(rows)
    del rows
    release(spark)
    rows = doubled(halves.select(F.col("rank").alias("a"), F.col("c").alias("b"), "pos"))
    discard(spark, path)
    release(spark)
    return rows.where(F.col("pos") > F.col("rank")).select("pos", F.lit(1).alias("n"))


def spans_of(gone: str, length: int):
    """[start, start + n - 1 + length) of each of an array of (start, n), as (start, end), sorted; they may overlap."""
    ordered = F.sort_array(F.coalesce(F.col(gone), F.array().cast("array<struct<start:bigint,n:int>>")))
    return F.transform(ordered, lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["n"] - 1 + length).alias("end")))


def without(text: bytes, spans: list[dict]) -> tuple[bytes, int]:
    """The text without the spans (sorted by start, may overlap), and the number of maximal runs removed."""
    out, at, runs = [], 0, 0
    for i, r in enumerate(spans):
        if r["start"] > at or not i:
            runs += 1
            out.append(text[at : r["start"]])
        at = max(at, r["end"])
    out.append(text[at:])
    return b"".join(out), runs


def cut_out(buf: np.ndarray, off: np.ndarray, spans: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts of buf without their spans, an array of (start, end) for each text: bytes, offsets, and the number of
    maximal runs removed from each."""
    n, flat = np.array(pa.compute.fill_null(pa.compute.list_value_length(spans), 0)), spans.flatten()
    base = np.repeat(off[:-1], n)
    starts, ends = (base + np.array(flat.field(c), np.int64) for c in ("start", "end"))
    # the number of spans that cover a byte: those that began less those that ended
    cover = np.bincount(starts, minlength=len(buf) + 1) - np.bincount(ends, minlength=len(buf) + 1)
    gone = np.cumsum(cover[:-1]) > 0
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    edges = off[:-1][off[:-1] < len(buf)]
    begins[edges] = gone[edges]
    places = np.flatnonzero(gone)
    return buf[~gone], off - np.searchsorted(places, off), np.diff(np.searchsorted(np.flatnonzero(begins), off))


def _keep(batches):
    """Arrow function (doc_id, text, spans) -> doc_id, kept bytes and the counts."""
    for batch in batches:
        for part in slices(batch, 1, NARROW):
            buf, off = texts_of(part.column(1))
            kept, at, runs = cut_out(buf, off, part.column(2))
            digests = [hashlib.sha256(kept[lo:hi]).hexdigest() for lo, hi in zip(at[:-1], at[1:], strict=True)]
            yield table({
                "doc_id": part.column(0), "n_bytes": pa.array(np.diff(off)), "n_removed": pa.array(np.diff(off - at)), "n_spans": pa.array(runs),
                "kept": pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(kept)]), "kept_sha256": pa.array(digests, pa.string()),
            })


def deduplicated(docs: DataFrame, length: int = 100, seed: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes) and kept_sha256 of each document."""
    spans = removed_spans(docs, length, seed)
    return spans.mapInArrow(_keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the strings of 100 bytes or more that occur earlier."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return deduplicated(docs, 100).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OP3_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
     w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS x FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM d WHERE n >= 100)),
     f AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, p) > 1),
     g AS (SELECT doc_id, p, max(p + 100) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f),
     i AS (SELECT doc_id, p, sum(CASE WHEN reach IS NULL OR p > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM g),
     s AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY doc_id, island),
     q AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS lo, a AS hi FROM s
           UNION ALL SELECT s.doc_id, max(b), max(n) FROM s JOIN d USING (doc_id) GROUP BY s.doc_id),
     k AS (SELECT doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS kept FROM q JOIN d USING (doc_id) GROUP BY doc_id),
     r AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN r USING (doc_id)
"""
