"""Anchors of nodes in running text: the terms that name nodes, and texts split at their occurrences.

Texts are searched for all terms at once by an Aho-Corasick automaton, as flat arrays with a full table of transitions.
Terms beyond one automaton's size go to further automata, each passed over the texts in turn.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute is used below
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.plans.state import written

# Words that name a kind of node and no node, and the least length of each kind of term.
GENERIC_TERMS = ("定义", "定理", "引理", "推论", "公理", "命题", "性质", "例子", "证明", "注记")
LEAST = {"title_zh": 3, "title_en": 4, "term": 4}

#: Bytes of terms in one automaton, hence states; the table has at most 257 columns of 4 bytes each.
AUTOMATON_BYTES = 1 << 16
#: Bytes that one lane of a search goes through; all lanes of a batch go step by step.
LANE = 1 << 11


def text_anchors(nodes: DataFrame) -> DataFrame:
    """nodes(id, pos, label, title_zh, title_en, terms array) -> (key, term, node, place).

    A node is named by its label, if that has a digit; by its titles and terms, if they are long enough and no generic
    word. Of nodes with one name, whatever its case, the first by pos has it (then by id, then by kind of name). place
    numbers the names within each length, which stands first: longer ones win where several fit.
    """
    trimmed = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    named = lambda i, ok, t: F.when(ok, F.struct(F.lit(i).alias("i"), t.alias("term")))
    told = lambda t, kind: (F.char_length(t) >= LEAST[kind]) & (F.lit(kind == "title_en") | ~t.isin(*GENERIC_TERMS))
    titles = [named(i, told(trimmed(c), c), trimmed(c)) for i, c in ((1, "title_zh"), (2, "title_en"))]
    terms = F.transform(F.coalesce("terms", F.array().cast("array<string>")), lambda t, i: named(i + 3, told(t, "term"), t))
    names = F.array_compact(F.concat(F.array(named(0, trimmed("label").rlike("[0-9]"), trimmed("label")), *titles), terms))
    each = nodes.select("id", "pos", F.explode(names).alias("n")).select(F.lower("n.term").alias("key"), F.struct("pos", "id", "n.i").alias("at"), F.struct("n.term", F.col("id").alias("node"), "pos", "n.i").alias("who"))
    first = each.where("key <> ''").groupBy("key").agg(F.min_by("who", "at").alias("who"))
    return first.select("key", "who.term", "who.node", F.struct(F.char_length("who.term").alias("length"), F.col("who.pos").alias("pos"), F.col("who.node").alias("id"), F.col("who.i").alias("i")).alias("place"))


class Automaton:
    """All occurrences of patterns in bytes. delta[state, class] is the next state; a state that ends a pattern has its length
    and number, and `up` is the next shorter pattern that ends there too, or -1."""

    def __init__(self, patterns: list[bytes]):
        used = sorted(set(b"".join(patterns)))
        self.cls = np.zeros(256, np.int32)
        self.cls[used] = np.arange(1, len(used) + 1)
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        levels: list[list[tuple[int, int, int]]] = []
        for number, p in enumerate(patterns):
            state = 0
            for depth, c in enumerate(self.cls[np.frombuffer(p, np.uint8)].tolist()):
                if c not in children[state]:
                    children[state][c] = len(children)
                    if depth == len(levels):
                        levels.append([])
                    levels[depth].append((state, c, len(children)))
                    children.append({})
                state = children[state][c]
            if p:
                ends.setdefault(state, number)
        n = len(children)
        self.delta = np.zeros((n, len(used) + 1), np.int32)
        fail, self.length, self.number, self.up = np.zeros(n, np.int32), np.zeros(n, np.int32), np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        self.number[list(ends)] = list(ends.values())
        self.length[list(ends)] = [len(patterns[i]) for i in ends.values()]
        for level in levels:  # shorter states, to which failures lead, have all their links before a level's rows are copied from theirs
            parent, c, state = np.array(level).T
            fail[state] = np.where(parent > 0, self.delta[fail[parent], c], 0)
            self.delta[parent, c] = state
            self.up[state] = np.where(self.number[fail[state]] >= 0, fail[state], self.up[fail[state]])
            self.delta[state] = self.delta[fail[state]]
        self.any = (self.number >= 0) | (self.up >= 0)
        self.longest = max(map(len, patterns), default=0)

    def occurrences(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and pattern of every occurrence in texts buf[off[i]:off[i + 1]], none across texts."""
        size = np.diff(off)
        lanes = -(-size // LANE)
        text = np.repeat(np.arange(len(size)), lanes)
        own = off[text] + LANE * (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
        to = np.minimum(own + LANE, off[text + 1])
        at = np.maximum(own - max(self.longest - 1, 0), off[text])  # what comes before gives the state at the lane's own start
        order = np.argsort(at - to, kind="stable")
        at, to, own = at[order], to[order], own[order]
        steps = to - at
        state, found = np.zeros(len(at), np.int32), []
        cls = self.cls[buf]
        for t in range(int(steps[0]) if len(steps) else 0):
            live = int(np.searchsorted(-steps, -t, "left"))
            where = at[:live] + t
            state[:live] = self.delta[state[:live], cls[where]]
            hit = np.flatnonzero(self.any[state[:live]])
            hit = hit[where[hit] >= own[:live][hit]]
            if len(hit):
                found.append((where[hit] + 1, state[hit].copy()))
        end, state = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int32))
        out = []
        while len(state):
            ends = self.number[state] >= 0
            out.append((end[ends] - self.length[state[ends]], self.length[state[ends]], self.number[state[ends]]))
            end, state = end[self.up[state] >= 0], self.up[state][self.up[state] >= 0]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.fill_null("").cast(pa.large_string())
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


#: Bytes of text that one search takes at a time, or one text.
SLICE = 1 << 22
FOUND = "array<struct<start:long,length:long,node:long>>"


def _marked(shared):
    """Arrow function (text, found, ...) -> the same, with `found` extended by what this automaton finds, sorted by start, longest first."""

    def run(batches):
        automaton, nodes = shared.value
        for batch in batches:
            ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, "right")))
                part = batch.slice(lo, hi - lo)
                lo = hi
                buf, off = _bytes(part.column(0))
                start, length, number = automaton.occurrences(buf, off)
                text, node = np.searchsorted(off, start, "right") - 1, nodes[number]
                start = start - off[text]
                old = part.column(1)
                flat = old.flatten()
                if len(flat):
                    old_text = np.repeat(np.arange(part.num_rows), pa.compute.list_value_length(old).to_numpy(zero_copy_only=False))
                    old_start, old_length, old_node = (flat.field(i).to_numpy() for i in range(3))
                    text, start, length, node = np.r_[text, old_text], np.r_[start, old_start], np.r_[length, old_length], np.r_[node, old_node]
                order = np.lexsort((-length.astype(np.int64), start, text))
                per = np.r_[0, np.cumsum(np.bincount(text, minlength=part.num_rows))].astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(x[order].astype(np.int64)) for x in (start, length, node)], ["start", "length", "node"])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(per), items), *part.columns[2:]], schema=pa.schema([batch.schema.field(0), pa.field("found", pa.list_(items.type)), *list(batch.schema)[2:]]))

    return run


def _cut(batches):
    """Arrow function (text, found, ...) -> (..., place, kind, src, node): leftmost matches, the longest first, and what lies between."""
    for batch in batches:
        buf, off = _bytes(batch.column(0))
        row, place, bounds, node = [], [], [], []
        flat = batch.column(1).flatten()
        starts, lengths, nodes = (flat.field(i).to_pylist() for i in range(3))
        at = 0
        for i, n in enumerate(pa.compute.list_value_length(batch.column(1)).to_pylist()):
            size, last, k = int(off[i + 1] - off[i]), 0, 0
            for j in range(at, at + n):
                if starts[j] < last:
                    continue
                if starts[j] > last:
                    row.append(i), place.append(k), bounds.append((last, starts[j])), node.append(None)
                    k += 1
                last = starts[j] + lengths[j]
                row.append(i), place.append(k), bounds.append((starts[j], last)), node.append(nodes[j])
                k += 1
            if last < size:
                row.append(i), place.append(k), bounds.append((last, size)), node.append(None)
            at += n
        pieces = [bytes(buf[off[i] + a : off[i] + b]).decode("utf-8", "replace") for i, (a, b) in zip(row, bounds, strict=True)]
        rest = [c.take(pa.array(row, pa.int64())) for c in batch.columns[2:]]
        kind = pa.array(["text" if n is None else "anchor" for n in node], pa.string())
        yield pa.RecordBatch.from_arrays([*rest, pa.array(place, pa.int64()), kind, pa.array(pieces, pa.string()), pa.array(node, pa.int64())], names=[*batch.schema.names[2:], "place", "kind", "src", "node"])


def split_by_anchors(texts: DataFrame, anchors: DataFrame) -> DataFrame:
    """texts(text, ...), anchors(term, node long) -> (..., place, kind, src, node): each text as its parts in order, `anchor` where
    a term stands (case counts; leftmost first, of several there the longest) and `text` between.

    A null or empty text has no part. Terms are read in groups of AUTOMATON_BYTES, one automaton at a time on the driver
    and one pass over the texts for each group, without a shuffle of texts; of equal terms the least node counts.
    """
    spark = texts.sparkSession
    terms = anchors.where("term <> ''").groupBy("term").agg(F.min("node").cast("long").alias("node")).withColumn("n", F.octet_length("term"))
    groups = max(1, -(-(terms.agg(F.sum("n")).first()[0] or 0) // AUTOMATON_BYTES))
    terms = written(terms.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(groups))), "terms") if groups > 1 else terms.withColumn("part", F.lit(0))
    others = [c for c in texts.columns if c != "text"]
    out = texts.select("text", F.lit(None).cast(FOUND).alias("found"), *others).withColumn("found", F.coalesce("found", F.array().cast(FOUND)))
    for part in range(groups):
        rows = terms.where(F.col("part") == part).select("term", "node").collect()
        if rows:
            shared = spark.sparkContext.broadcast((Automaton([r.term.encode() for r in rows]), np.array([r.node for r in rows], np.int64)))
            out = out.mapInArrow(_marked(shared), out.schema)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields[2:])
    return out.mapInArrow(_cut, (types + ", " if types else "") + "place long, kind string, src string, node long")
