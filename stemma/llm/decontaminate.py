"""Benchmark decontamination by a generalised suffix automaton of the items' words.

The automaton holds every run of words of every item. A document streams through it: at each word the state is the
longest run of the document that ends there and occurs in some item. A run reaches a window when its length reaches
the window's; the covered words are hit.

Items are dealt into shards of at most SHARD_WORDS words (or one item). Spark builds each shard's automaton once, in a
task of its own, as flat arrays of some 60 bytes a word, and writes it to the shared folder. Documents pass through the
shards in turn, each read from its file, one at a time in a worker: memory is bounded however large the benchmark is,
and the result is the same. Nothing of the benchmark comes to the driver.
"""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytescan import NARROW, give_back, lowered, slices, texts_of, words_of
from .common import only, shared_dir, text_batches
from .files import AtomicFile, system, table

#: Words of items in one automaton. While one is built it takes some 900 bytes a word.
SHARD_WORDS = 200_000
#: Bytes of a word: digits, letters of either case, everything outside ASCII.
WORD = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def item_words(text: str | None) -> list[bytes]:
    """The lower-cased words of one text."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    buf = lowered(raw)
    start, end, _ = words_of(buf, np.array([0, len(buf)]), WORD)
    data = buf.tobytes()
    return [data[s:e] for s, e in zip(start, end, strict=True)]


class Automaton:
    """Flat arrays, in a file or in memory.

    words: the vocabulary, in order of its ids; edge, to: transitions, sorted by state * vocabulary + word; link: suffix
    link; size: longest run; first, need, item: the windows that a state completes by itself, as lengths and items,
    those of state s from first[s] to first[s + 1]; up: the next state on the suffix path with such windows, or -1;
    least: the shortest window; pairs: neighbouring words of items, as first * vocabulary + second, in order.
    """

    FIELDS = ("edge", "to", "link", "size", "first", "need", "item", "up", "least", "pairs")

    def __init__(self, words: pa.Array, names: list[str], **arrays: np.ndarray):
        self.words, self.names = words, names
        for f in self.FIELDS:
            setattr(self, f, arrays[f])

    def save(self, uri: str, attempt: str) -> None:
        """Written so that a retried task can write it again."""
        out = io.BytesIO()
        with pa.ipc.new_stream(out, pa.schema([("words", pa.large_binary())])) as w:
            w.write_table(pa.table({"words": self.words}))
        texts = {"_words": np.frombuffer(out.getvalue(), np.uint8), "_names": np.frombuffer(json.dumps(self.names).encode(), np.uint8)}
        data = io.BytesIO()
        np.savez(data, **{f: getattr(self, f) for f in self.FIELDS}, **texts)
        f = AtomicFile(uri, attempt)
        f.write(data.getvalue())
        f.commit()

    @classmethod
    def load(cls, uri: str) -> Automaton:
        where, path = system(uri)
        with where.open_input_file(path) as f:
            got = np.load(io.BytesIO(f.read()))
            words = pa.ipc.open_stream(got["_words"].tobytes()).read_all()["words"].combine_chunks()
            words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
            return cls(words, json.loads(got["_names"].tobytes()), **{f: got[f] for f in cls.FIELDS})

    def reader(self) -> Reader:
        return Reader(self)


def build(items: list[list[bytes]], names: list[str], window: int) -> Automaton:
    """The generalised suffix automaton of the items, with the windows that each state completes."""
    vocabulary: dict[bytes, int] = {}
    for ws in items:
        for w in ws:
            vocabulary.setdefault(w, len(vocabulary))
    follow: list[dict[int, int]] = [{}]
    link, size = [-1], [0]

    def clone_of(q: int, p: int, c: int) -> int:
        follow.append(dict(follow[q]))
        size.append(size[p] + 1)
        link.append(link[q])
        new = len(size) - 1
        while p >= 0 and follow[p].get(c) == q:
            follow[p][c] = new
            p = link[p]
        link[q] = new
        return new

    for ws in items:
        last = 0
        for w in ws:
            c = vocabulary[w]
            if (q := follow[last].get(c)) is not None:
                last = q if size[q] == size[last] + 1 else clone_of(q, last, c)
                continue
            follow.append({})
            size.append(size[last] + 1)
            link.append(0)
            new, p = len(size) - 1, last
            while p >= 0 and c not in follow[p]:
                follow[p][c] = new
                p = link[p]
            if p >= 0:
                q = follow[p][c]
                link[new] = q if size[q] == size[p] + 1 else clone_of(q, p, c)
            last = new
    # windows: walk each item once more; the state of a window is the one on its suffix path that holds its length
    own: set[tuple[int, int, int]] = set()
    for i, ws in enumerate(items):
        need, state, length = min(window, len(ws)), 0, 0
        for w in ws:
            state, length = follow[state][vocabulary[w]], length + 1
            if length >= need:
                at = state
                while size[link[at]] >= need:
                    at = link[at]
                own.add((at, need, i))
                if length == need == window:
                    # keep the run at one word under the window, so the next word completes the next window
                    state, length = at, need
    owned = np.array(sorted(own), np.int64).reshape(-1, 3)
    n = len(size)
    first = np.searchsorted(owned[:, 0], np.arange(n + 1))
    up = np.full(n, -1, np.int32)
    for s in sorted(range(1, n), key=size.__getitem__):
        above = link[s]
        up[s] = above if first[above + 1] > first[above] else up[above]
    v = len(vocabulary)
    edge = np.fromiter((s * v + c for s, f in enumerate(follow) for c in f), np.int64)
    to = np.fromiter((t for f in follow for t in f.values()), np.int32)
    order = np.argsort(edge)
    pairs = np.unique(np.fromiter((vocabulary[x] * v + vocabulary[y] for ws in items for x, y in zip(ws, ws[1:], strict=False)), np.int64))
    return Automaton(
        pa.array(list(vocabulary), pa.large_binary()), names, edge=edge[order], to=to[order], link=np.array(link, np.int32), size=np.array(size, np.int32), first=first.astype(np.int32),
        need=owned[:, 1].astype(np.int32), item=owned[:, 2].astype(np.int32), up=up, least=np.array([min((min(window, len(ws)) for ws in items if ws), default=window)]), pairs=pairs,
    )


class Reader:
    """An automaton at work on runs of words."""

    def __init__(self, a: Automaton):
        self.a, self.v = a, len(a.words)

    def runs(self, ids: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
        """The runs of a text's words that can hold a window: known words (ids from 0), all neighbours of which are
        neighbours in some item, and no shorter than the shortest window. No match of two words spans their ends."""
        code = ids[:-1] * self.v + ids[1:]
        near = np.minimum(np.searchsorted(self.a.pairs, code), max(0, len(self.a.pairs) - 1))
        ok = (self.a.pairs[near] == code) if len(self.a.pairs) else np.zeros(len(code), bool)
        joined = ok & (ids[:-1] >= 0) & (ids[1:] >= 0) & (doc[1:] == doc[:-1])
        begin = np.flatnonzero(np.r_[True, ~joined])
        end = np.r_[begin[1:], len(ids)]
        long = (end - begin >= self.a.least[0]) & (ids[begin] >= 0)
        return list(zip(begin[long].tolist(), end[long].tolist(), strict=True))

    def _follow(self, state: int, c: int) -> int:
        key = state * self.v + c
        at = int(np.searchsorted(self.a.edge, key))
        return int(self.a.to[at]) if at < len(self.a.edge) and self.a.edge[at] == key else -1

    def stream(self, words: list[int], hit: np.ndarray, items: set[int]) -> None:
        """Mark the words of a run (ids of the vocabulary) that windows cover, and add the items of those windows."""
        a, follow = self.a, self._follow
        state = length = 0
        for i, c in enumerate(words):
            while (to := follow(state, c)) < 0 and state:
                state = int(a.link[state])
                length = int(a.size[state])
            if to < 0:
                state = length = 0
                continue
            state, length = to, length + 1
            at = state
            while at >= 0:
                lo, hi = a.first[at], a.first[at + 1]
                for need, who in zip(a.need[lo:hi].tolist(), a.item[lo:hi].tolist(), strict=True):
                    if need <= length:
                        hit[i + 1 - need : i + 1] = True
                        items.add(who)
                at = int(a.up[at])


def _built(path: str, window: int):
    """Arrow function (shard, item, text), sorted by shard -> (shard) of each automaton written."""

    def save(shard: int, rows: list[tuple[str, str]]) -> pa.RecordBatch:
        from pyspark import TaskContext

        build([item_words(t) for _, t in rows], [n for n, _ in rows], window).save(f"{path}/{shard}.npz", str(TaskContext.get().taskAttemptId()))
        give_back()
        return table({"shard": pa.array([shard], pa.int64())})

    def run(batches):
        at, rows = None, []
        for batch in batches:
            for shard, item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != at and rows:
                    yield save(at, rows)
                    rows = []
                at = shard
                rows.append((item, text))
        if rows:
            yield save(at, rows)

    return run


def _words_sql(text):
    """How many words a text has, in the JVM."""
    return F.size(F.regexp_extract_all(F.lower(text), F.lit("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), F.lit(0))).cast("long")


def automata(benchmark: DataFrame, window: int) -> list[str]:
    """The files of the shards' automata, built by Spark: one task's memory holds one shard."""
    spark, path = benchmark.sparkSession, shared_dir(benchmark.sparkSession, "automata")
    items = only(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text", _words_sql(F.col("text")).alias("n")).where("n > 0")
    if not items.limit(1).count():
        return []
    # numbered file by file: each file's items by the running sum of their words, file after file by prefix sums
    items.write.parquet(f"{path}/items")
    rows = spark.read.schema(items.schema).parquet(f"{path}/items").withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    upto = F.sum("n").over(Window.partitionBy("_file").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    shard = F.floor((upto - 1) / SHARD_WORDS)
    named = rows.select("_file", shard.alias("_s"), "item", "text")
    counts = named.groupBy("_file", "_s").count()
    order = counts.select("_file", "_s", (F.row_number().over(Window.orderBy("_file", "_s")) - 1).cast("long").alias("shard"))
    dealt = named.join(order, ["_file", "_s"]).select("shard", "item", "text").repartition(counts.count(), "shard").sortWithinPartitions("shard")
    done = dealt.mapInArrow(_built(path, window), "shard long").collect()
    return sorted(f"{path}/{r.shard}.npz" for r in done)


def _through(paths: list[str]):
    """Arrow function (doc_id, text) -> the columns of `contamination`."""

    def run(batches):
        kept: list[Automaton] = []

        def shards() -> Iterator[Automaton]:
            """Each automaton; kept for the next texts where there is only one."""
            if len(paths) == 1:
                kept[:] = kept or [Automaton.load(paths[0])]
                yield kept[0]
                return
            for p in paths:
                yield Automaton.load(p)

        for batch in batches:
            for part in slices(batch, 1, 1 << 24 if len(paths) > 1 else NARROW):
                buf, off = texts_of(part.column(1))
                start, end, doc = words_of(buf, off, WORD)
                # the words themselves, every second stretch between bounds, so that equal means equal bytes
                bounds = np.stack([start, end], axis=1).reshape(-1)
                words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), max(0, len(bounds) - 1), [None, pa.py_buffer(bounds), pa.py_buffer(lowered(buf))])
                words = words.take(pa.array(np.arange(0, len(words), 2))).dictionary_encode() if len(words) else None
                hit = np.zeros(len(start), bool)
                found: dict[int, set[str]] = {}
                for a in shards() if words is not None else ():
                    known = pa.compute.index_in(words.dictionary, value_set=a.words).fill_null(-1).to_numpy(zero_copy_only=False)
                    ids = known[words.indices.to_numpy()]
                    reader = a.reader()
                    for lo, hi in reader.runs(ids.astype(np.int64), doc):
                        items: set[int] = set()
                        reader.stream(ids[lo:hi].tolist(), hit[lo:hi], items)
                        if items:
                            found.setdefault(int(doc[lo]), set()).update(a.names[i] for i in items)
                n_words = np.bincount(doc, minlength=part.num_rows)
                n_hit = np.bincount(doc[hit], minlength=part.num_rows)
                listed = [sorted(found.get(d, ())) for d in range(part.num_rows)]
                run_at = np.flatnonzero(hit & np.r_[True, ~hit[:-1] | (doc[1:] != doc[:-1])]) if len(hit) else np.empty(0, np.int64)
                run_to = np.flatnonzero(hit & np.r_[~hit[1:] | (doc[1:] != doc[:-1]), True]) if len(hit) else np.empty(0, np.int64)
                per = np.bincount(doc[run_at], minlength=part.num_rows)
                base = off[doc[run_at]]
                spans = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per)].astype(np.int32)), pa.StructArray.from_arrays([pa.array(start[run_at] - base), pa.array(end[run_to] - base)], ["start", "end"]))
                yield table({
                    "doc_id": part.column(0), "n_words": pa.array(n_words.astype(np.int64)), "n_hit": pa.array(n_hit.astype(np.int64)),
                    "n_items": pa.array([len(x) for x in listed], pa.int64()), "items": pa.array(listed, pa.list_(pa.string())),
                    "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in listed], pa.string()), "spans": spans,
                } | {f"_{i}": c for i, c in enumerate(part.columns[2:])})

    return run


OUT = "doc_id long, n_words long, n_hit long, n_items long, items array<string>, items_sha256 string, spans array<struct<start:long,end:long>>"


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, n_words, n_hit, n_items, items, items_sha256,
    spans (byte ranges of hit words in the text), contaminated (any hit, and share * n_hit >= n_words), and the
    columns of docs to carry.

    A null, empty or wordless text has no words, no hits and isn't contaminated; a null, empty or wordless item has
    no window; items of equal text or id are all counted, ids as strings, null ids as the string "null". Repeated
    rows are each judged. Other columns are ignored.
    """
    text_batches(docs.sparkSession)
    paths = automata(benchmark, window)
    rest = [f"_{i}" for i in range(len(carry))]
    docs = only(docs, *dict.fromkeys(("doc_id", "text", *carry)))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[F.col(f"`{c}`").alias(r) for c, r in zip(carry, rest, strict=True)])
    more = "".join(f", {r} {docs.schema[r].dataType.simpleString()}" for r in rest)
    out = docs.mapInArrow(_through(paths), OUT + more).withColumnsRenamed(dict(zip(rest, carry, strict=True)))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each document repeats benchmark items."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP8_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
     i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
     im AS (SELECT item_id, w, least(13, len(w)) AS m FROM i WHERE len(w) > 0),
     iw AS (SELECT DISTINCT item_id, m, array_to_string(w[j:j + m - 1], ' ') AS win FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS j FROM im)),
     ms AS (SELECT DISTINCT m FROM iw),
     dw AS (SELECT doc_id, m, k, array_to_string(w[k:k + m - 1], ' ') AS win FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, ms WHERE len(w) >= m)),
     h AS (SELECT doc_id, item_id, k, m FROM dw JOIN iw USING (m, win)),
     n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM h) GROUP BY doc_id),
     t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
