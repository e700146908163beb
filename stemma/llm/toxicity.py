"""Toxicity by a support vector machine over the gap-weighted subsequence kernel, with Nyström landmarks.

The kernel of two words adds up, over all sequences of three (of four) symbols, the products of their weights in either:
an occurrence over a stretch of s symbols weighs DECAY ** s, so an insult with inserted or dropped characters stays near
the insult. Each is normalised by both words' own kernels, and the two orders' mean is taken. Landmarks are words of
labelled texts; a word's features are its kernels with them, whitened. The decision is linear in the features, so it
equals a sum of weights of the word's subsequences over its norms: tables of ALPHABET ** 3 and ** 4 numbers score words.

Labels are given for documents, but what is toxic is a sentence. A sentence is as toxic as its worst word, a document as
its worst sentence. Training alternates (multiple-instance learning): the worst sentence of each toxic document, by the
machine so far, stands for it, and the worst one of each clean document is a counterexample; then the machine is fitted
anew. At last the worst score is brought to a probability by logistic regression.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import NOT_SPACE, lowered, slices, texts_of, words_of
from .common import only, text_batches, written
from .files import table

#: Labelled rows that are learned from: the most of either label, by a hash of their ids. Everything is scored.
MOST_TOXIC, MOST_CLEAN = 5000, 15000
#: Landmarks, words that training starts from, and rounds.
LANDMARKS, STARTERS, ROUNDS = 192, 6000, 3
DECAY, ORDERS = 0.7, (3, 4)
#: Longer words are read in windows of so many bytes, each half over the one before.
WINDOW = 16
ALPHABET = 32
#: The score before calibration of a text without words.
LOWEST = -4.0

_SYMBOL = np.zeros(256, np.int32)  # 0 is a gap, equal to nothing
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[48:58] = [*b"\x0f\x09\x1b\x05\x01\x13\x1b\x14\x1b\x1b"]  # as the letters they are written for: 0 o, 1 i, 3 e, 4 a, 5 s, 7 t
_SYMBOL[128:] = 28 + np.arange(128) % 4
_SENTENCE = np.zeros(256, bool)
_SENTENCE[[*b".!?", 10, 13]] = True
_PLACES = {(n, k): np.array(list(combinations(range(n), k))).T for k in ORDERS for n in range(k, WINDOW + 1)}


def windows(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and word number of the windows of words buf[start:end], in order."""
    step = WINDOW // 2
    n = np.maximum(0, -(-(end - start - WINDOW) // step)) + 1
    word = np.repeat(np.arange(len(start)), n)
    at = start[word] + step * (np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n))
    return at, np.minimum(end[word] - at, WINDOW), word


def own_kernels(symbols: np.ndarray) -> dict[int, np.ndarray]:
    """Each row's kernel with itself, by order, by the usual recursion over prefixes."""
    rows, n = symbols.shape
    equal = {(p, q): ((symbols[:, p] == symbols[:, q]) & (symbols[:, p] > 0)).astype(np.float32) * np.float32(DECAY**2) for p in range(n) for q in range(n)}
    before, out, none = {(p, q): np.ones(rows, np.float32) for p in range(n + 1) for q in range(n + 1)}, {}, np.zeros(rows, np.float32)
    for order in range(1, max(ORDERS) + 1):
        both = {(p, q): e * before[p, q] for (p, q), e in equal.items()}
        out[order] = sum(both.values(), none)
        now = {(p, 0): none for p in range(n + 1)} | {(0, q): none for q in range(n + 1)}
        for p in range(1, n + 1):
            run = none
            for q in range(1, n + 1):
                run = DECAY * run + both[p - 1, q - 1]
                now[p, q] = DECAY * now[p - 1, q] + run
        before = now
    return out


def each_length(buf: np.ndarray, at: np.ndarray, length: np.ndarray, most: int = 1 << 21):
    """(order, window numbers, codes of their subsequences, the subsequences' weights, norms), windows of one length at a time."""
    for n in range(min(ORDERS), WINDOW + 1):
        which = np.flatnonzero(length == n)
        for lo in range(0, len(which), step := max(1, most // _PLACES[n, min(n, max(ORDERS))].shape[1])):
            some = which[lo : lo + step]
            s = _SYMBOL[buf[at[some][:, None] + np.arange(n)]]
            own = own_kernels(s)
            for order in ORDERS:
                if n >= order:
                    places = _PLACES[n, order]
                    code = s[:, places[0]]
                    for x in places[1:]:
                        code = np.where((code > 0) & (s[:, x] > 0), code * ALPHABET + s[:, x], 0)
                    yield order, some, code, np.float32(DECAY) ** (places[-1] - places[0] + 1), np.maximum(np.sqrt(own[order]), 1e-9)


def packed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words back to back: bytes, starts, ends."""
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return np.frombuffer(b"".join(words) or b"\0", np.uint8), np.r_[0, ends[:-1]].astype(np.int64) if words else ends, ends


class Landmarks:
    """Landmark windows as tables of their subsequences' normalised weights, and the whitening of kernels with them."""

    def __init__(self, words: list[bytes]):
        buf, start, end = packed(words)
        self.row, self.weights = {}, {}
        found = list(each_length(buf, start, end - start))
        for order in ORDERS:
            codes = np.unique(np.concatenate([c.reshape(-1) for o, _, c, _, _ in found if o == order] or [np.zeros(0, np.int32)]))
            codes = codes[codes > 0]
            self.row[order] = np.full(ALPHABET**order, len(codes), np.int32)  # the last row, of zeros, is of codes that no landmark has
            self.row[order][codes] = np.arange(len(codes))
            self.weights[order] = np.zeros((len(codes) + 1, len(words)), np.float32)
        for order, who, code, weight, norm in found:
            for w, c, n in zip(who, code, norm, strict=True):
                np.add.at(self.weights[order][:, w], self.row[order][c[c > 0]], weight[c > 0] / n)
        value, vector = np.linalg.eigh(self.kernels(buf, start, end - start).astype(np.float64))
        self.white = (vector / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
        self.known: dict[bytes, np.ndarray] = {}

    def kernels(self, buf: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The mean normalised kernel of each window with each landmark; 0 where a window has too few symbols."""
        out = np.zeros((len(at), next(iter(self.weights.values())).shape[1]), np.float32)
        for order, who, code, weight, norm in each_length(buf, at, length, 1 << 15):
            out[who] += np.einsum("c,wcm->wm", weight, self.weights[order][self.row[order][code]]) / norm[:, None] / len(ORDERS)
        return out

    def features(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in words if w not in self.known]
        buf, start, end = packed(new)
        self.known |= dict(zip(new, self.kernels(buf, start, end - start) @ self.white, strict=True))
        return np.array([self.known[w] for w in words])

    def tables(self, w: np.ndarray) -> dict[int, np.ndarray]:
        """By order, the weight of each subsequence under the decision w."""
        return {k: (self.weights[k] @ (self.white @ w) / len(ORDERS)).astype(np.float32)[self.row[k]] for k in ORDERS}


def fitted(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and bias of the linear machine of least squared hinge loss, by Newton's method. y is 1 or -1."""
    x = np.c_[x, np.ones(len(x))].astype(np.float64)
    w = np.zeros(x.shape[1])
    penalty = np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    loss = lambda w: (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum() + (penalty * w * w).sum()
    for _ in range(50):
        inside = y * (x @ w) < 1
        a = x[inside] * weight[inside, None]
        step = np.linalg.solve(a.T @ x[inside] + np.diag(penalty), a.T @ y[inside]) - w
        size, now = 1.0, loss(w)
        while loss(w + size * step) > now and size > 1e-4:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def calibrated(raw: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make raw scores log odds, by logistic regression with targets held off 0 and 1."""
    pos, neg = label.sum(), (1 - label).sum()
    target = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.c_[raw, np.ones(len(raw))]
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return max(float(w[0]), 1e-6), float(w[1])


@dataclass
class Model:
    """Scores of words by their subsequences; the log odds of a text by its worst word."""

    tables: dict[int, np.ndarray]
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def words(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The score of each word, its worst window's."""
        at, length, word = windows(buf, start, end)
        score = np.full(len(at), self.bias, np.float32)
        for order, who, code, weight, norm in each_length(buf, at, length):
            score[who] += self.tables[order][code] @ weight / norm
        return np.maximum.reduceat(score, np.searchsorted(word, np.arange(len(start)))) if len(start) else score


def _groups(buf: np.ndarray, off: np.ndarray):
    """Start, end and text of the words, without symbols at their ends; then of runs of single letters with blanks between."""
    start, end, doc = words_of(buf, off, NOT_SPACE)
    letters = np.flatnonzero(_SYMBOL[buf] > 0)
    if not len(letters):
        return
    first, last = np.searchsorted(letters, start), np.searchsorted(letters, end) - 1
    some = last >= first
    start, end, doc = letters[first[some]], letters[last[some]] + 1, doc[some]
    yield start, end, doc
    single = end - start == 1
    follows = np.r_[False, single[1:] & single[:-1] & (doc[1:] == doc[:-1]) & (start[1:] - end[:-1] <= 3)]
    opens, closes = np.flatnonzero(single & ~follows), np.flatnonzero(single & ~np.r_[follows[1:], False])
    long = closes - opens >= 2
    yield start[opens[long]], end[closes[long]], doc[opens[long]]


def _distinct(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of each range's bytes among the distinct ones, and those; ranges in order, without overlaps."""
    bounds = np.stack([start, end], axis=1).reshape(-1)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(buf)])
    coded = words.take(pa.array(np.arange(0, len(words), 2))).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    _, off, data = words.buffers()
    off = np.frombuffer(off, np.int64)[words.offset : words.offset + len(words) + 1]
    return np.frombuffer(data, np.uint8), off[:-1], off[1:]


def worst(model: Model, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's worst score, and start and end of the word that has it (the first such; -1 without a word)."""
    n = len(off) - 1
    score, at, to = np.full(n, LOWEST, np.float32), np.full(n, -1), np.full(n, -1)
    for start, end, doc in _groups(buf, off):
        if not len(start):
            continue
        number, words = _distinct(buf, start, end)
        own = model.words(*_bytes_of(words))[number]
        head = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        best = np.maximum.reduceat(own, head)
        where = np.flatnonzero(own == np.repeat(best, np.diff(np.r_[head, len(own)])))
        where = where[np.r_[True, doc[where][1:] != doc[where][:-1]]]
        more = own[where] > score[doc[where]]
        where = where[more]
        score[doc[where]], at[doc[where]], to[doc[where]] = own[where], start[where], end[where]
    return score, at, to


def _judged(model):
    """Arrow function (doc_id, text, ...) -> doc_id, score, start, end (the worst sentence's bytes in the text), word, and the further columns."""

    def run(batches):
        m = model.value
        for batch in batches:
            for part in slices(batch, 1):
                buf, off = texts_of(part.column(1))
                low = lowered(buf)
                raw, at, to = worst(m, low, off)
                p = 1 / (1 + np.exp(-np.clip(m.slope * raw.astype(np.float64) + m.offset, -30, 30)))
                ends = np.flatnonzero(_SENTENCE[buf]) if len(buf) else np.empty(0, np.int64)
                none = at < 0
                before, after = np.searchsorted(ends, at) - 1, np.searchsorted(ends, to)
                opens = np.maximum(np.where(before >= 0, ends[np.maximum(before, 0)] + 1 if len(ends) else 0, 0), off[:-1]) - off[:-1]
                closes = np.minimum(np.where(after < len(ends), ends[np.minimum(after, len(ends) - 1)] + 1 if len(ends) else 0, len(buf)), off[1:]) - off[:-1]
                words = [None if a < 0 else low[a:e].tobytes().decode("utf-8", "replace") for a, e in zip(at.tolist(), to.tolist(), strict=True)]
                yield table({
                    "doc_id": part.column(0), "raw": pa.array(raw.astype(np.float64)), "score": pa.array(np.round(p, 6)),
                    "start": pa.array(opens, mask=none), "end": pa.array(closes, mask=none), "word": pa.array(words, pa.string()),
                } | {f"_{i}": c for i, c in enumerate(part.columns[2:])})

    return run


SCORED = "doc_id long, raw double, score double, start long, end long, word string"


def _word_counts(batches):
    """Arrow function (toxic, text) -> (word, toxic, clean): texts of either kind that have it."""
    for batch in batches:
        for part in slices(batch, 1):
            buf, off = texts_of(part.column(1))
            buf = lowered(buf)
            toxic = part.column(0).to_numpy()
            for start, end, doc in _groups(buf, off):
                if not len(start):
                    continue
                number, words = _distinct(buf, start, end)
                pairs = np.unique(doc * len(words) + number)
                doc, number = pairs // len(words), pairs % len(words)
                n = np.bincount(number, minlength=len(words))
                bad = np.bincount(number, weights=toxic[doc], minlength=len(words)).astype(np.int64)
                short = pc.utf8_slice_codeunits(words.cast(pa.large_string()), 0, WINDOW).cast(pa.string())
                yield table({"word": short, "toxic": pa.array(bad), "clean": pa.array(n - bad)})


def _starters(train: DataFrame) -> tuple[list, list]:
    """Of the words of labelled texts: those that most mark toxic ones, best first, and others dealt by hash, as rows (word, toxic, clean)."""
    words = written(train.select("toxic", "text").mapInArrow(_word_counts, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "words")
    pos, neg = train.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    share = (F.col("toxic") + F.col("clean")) / (pos + neg)
    z = (F.col("toxic") / pos - F.col("clean") / neg) / F.sqrt(share * (1 - share) * (1 / pos + 1 / neg) + 1e-12)
    marked = words.withColumn("z", z).orderBy(F.desc("z"), "word").limit(STARTERS // 6).collect()
    usual = words.where("clean > 0").orderBy(F.desc("clean"), "word").limit(STARTERS // 6).collect()
    others = words.where("clean > 0").orderBy(F.xxhash64("word"), "word").limit(STARTERS).collect()
    return marked, usual + others


def _trained(train: DataFrame) -> Model:
    """train(doc_id, toxic, text), of both labels -> the machine."""
    marked, others = _starters(train)
    top = marked[0].z
    seeds = {r.word: float(r.toxic) for r in marked if r.z >= max(min(4.0, 0.7 * top), top / 8)}
    landmarks = Landmarks([r.word.encode()[:WINDOW] for r in dict.fromkeys(marked[: LANDMARKS // 2] + others[: LANDMARKS // 4] + others[-LANDMARKS // 4 :])])
    bad = dict(seeds)
    good = {r.word: 1.0 for r in others if r.word not in bad} | {r.word: float(r.clean) for r in marked if r.clean and r.word not in bad}
    for step in range(ROUNDS + 1):
        names = [*bad, *good]
        y = np.r_[np.ones(len(bad)), -np.ones(len(good))]
        own = np.sqrt([*bad.values(), *good.values()])  # a word of very many texts counts, but doesn't rule
        weight = own * np.where(y > 0, 1 / own[: len(bad)].sum(), 1 / own[len(bad) :].sum()) * 1000
        w = fitted(landmarks.features([n.encode()[:WINDOW] for n in names]), y, weight)
        model = Model(landmarks.tables(w[:-1]), float(w[-1]))
        seen = train.select("doc_id", "text", "toxic").mapInArrow(_judged(train.sparkSession.sparkContext.broadcast(model)), SCORED + ", _0 int").select("raw", "word", "_0").collect()
        if step == ROUNDS:
            model.slope, model.offset = calibrated(np.array([r.raw for r in seen]), np.array([r._0 for r in seen]))
            return model
        # the worst word of a toxic text joins the seeds where it is on their side, and that of a clean one the others
        votes: dict[str, list[int]] = {}
        for r in seen:
            if r.word is not None and (r.raw > 0 or not r._0):
                votes.setdefault(r.word[:WINDOW], [0, 0])[r._0] += 1
        rate = sum(r._0 for r in seen) / max(1, len(seen))
        bad = seeds | {k: float(p) for k, (n, p) in votes.items() if p * (1 - rate) > 2 * n * rate and k not in seeds}
        good = {k: v for k, v in (good | {k: good.get(k, 0.0) + n for k, (n, _) in votes.items() if n}).items() if k not in bad}


def learned_from(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """The labelled texts that training reads, written: (doc_id, toxic, text), at most MOST_TOXIC and MOST_CLEAN ids by hash.

    An id is toxic when any of its labels is. Texts alike teach once, as toxic if any of them is; null ids and labels teach nothing.
    """
    marks = only(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marks = marks.where(~held_out).orderBy(F.xxhash64("doc_id"))
    some = marks.where("toxic = 1").limit(MOST_TOXIC).unionByName(marks.where("toxic = 0").limit(MOST_CLEAN))
    found = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy(F.xxhash64("text").alias("hash"))
    return written(found.agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"), F.max("text").alias("text")).drop("hash"), "labelled")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, toxic) -> doc_id, held_out, score, predicted, start and end (bytes of the worst
    sentence), word (the worst word): one row per row.

    Labels of ids with crc32 % 5 = 0 are held out. Null, empty and wordless texts score as the least toxic. Repeated rows
    score alike, null ids are never held out or learned from, texts are whole, however long. Without labels of both kinds
    every score is the share of toxic labels (0 without any). An empty table gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    text_batches(spark)
    docs = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    train = learned_from(docs, labels, held_out)
    pos, neg = train.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    if pos and neg and train.where(F.col("text").rlike("[A-Za-z0-9\\x{80}-\\x{10FFFF}]")).limit(1).count():
        model = _trained(train)
    else:
        rate = min(max(pos / max(1, pos + neg), 1e-9), 1 - 1e-9)
        model = Model({k: np.zeros(ALPHABET**k, np.float32) for k in ORDERS}, 0.0, 0.0, float(np.log(rate / (1 - rate))))
    out = docs.mapInArrow(_judged(spark.sparkContext.broadcast(model)), SCORED)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "start", "end", "word")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How toxic each document is."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity(docs, labels).select("doc_id", "held_out", "score", "predicted", "word")
