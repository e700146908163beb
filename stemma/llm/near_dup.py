"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded, then verified.

A text is its words (A-Z lower-cased, parted by white space) in shingles of `size`; a text of fewer words is one
shingle. A shingle weighs its count in the text times the mean inverse document frequency of its words. Document
frequencies are of all documents, in a table of SLOTS slots by word hash: a fixed size whatever the corpus. (With
the shingle's own document frequency a passage copied thousands of times would weigh next to nothing, and large
groups of near copies would fall apart.)

1. Texts alike in their words fall together, whatever their number.
2. Each sample of a text is the shingle whose hash value, drawn by Ioffe's scheme for its weight, is least: two
   texts share it with a probability of their weighted Jaccard similarity. `bands` groups of `rows` samples are keys.
3. Texts that share a key are candidates. First each member of a key's group is compared with the group's centre, the
   member that shares its keys with most others: for copies of one text that is the text itself. What is found similar
   merges, so a large group of copies costs its size. Members of a key outside its largest class are then compared with
   all the others, in blocks: a task holds two blocks of at most BLOCK members or BLOCK_WORDS words on average, so no
   group is too large for one, no open pair is left out, and no pair is a row. Blocks are first judged by keys and samples
   alone; only members that may have a link bring their texts to a second round.
4. A pair is judged first by the share of equal samples (under `doubt`, five standard deviations below the threshold,
   it's rejected), then by the weighted Jaccard similarity of the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytescan import BASES, NARROW, NOT_SPACE, lowered, mix, range_hashes, slices, texts_of, words_of
from .common import heavy_join, hot_keys, only, ranked, release, text_batches, written
from .files import table
from .graph import components

SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
_U = np.uint64


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word."""
    buf = lowered(buf)
    start, end, doc = words_of(buf, off, NOT_SPACE)
    return range_hashes(buf, start, end, BASES[1]), doc


def _slot(words: np.ndarray) -> np.ndarray:
    return (words >> _U(64 - SLOT_BITS)).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function (text) -> (slot, n): documents of the partition in which a word of the slot occurs."""
    total = np.zeros(SLOTS, np.int64)
    for batch in batches:
        for part in slices(batch, 0, NARROW):
            words, doc = _words(*texts_of(part.column(0)))
            pairs = np.unique((doc << SLOT_BITS) | _slot(words))
            total += np.bincount(pairs & (SLOTS - 1), minlength=SLOTS)
    used = np.flatnonzero(total)
    yield table({"slot": pa.array(used.astype(np.int32)), "n": pa.array(total[used])})


def idf_table(docs: DataFrame) -> np.ndarray:
    """The smoothed inverse document frequency of each slot: SLOTS numbers, however large the corpus."""
    n_docs = docs.count()
    counts = docs.select("text").mapInArrow(_count_words, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(SLOTS)
    df[counts["slot"].to_numpy()] = counts["n"].to_numpy()
    return (1 + np.log((n_docs + 1) / (df + 1))).astype(np.float32)


def shingles(buf: np.ndarray, off: np.ndarray, idf: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and weight of each distinct shingle of each text, by text and then by hash."""
    words, doc = _words(buf, off)
    n = np.bincount(doc, minlength=len(off) - 1)
    first = np.cumsum(n) - n
    count = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    of = np.repeat(np.arange(len(n)), count)
    at = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    h, w, got = np.zeros(len(at), _U), np.zeros(len(at), np.float32), np.zeros(len(at), np.float32)
    weight = idf[_slot(words)]
    for j in range(size):
        inside = at + j < (first + n)[of]
        src = np.minimum(at + j, max(0, len(words) - 1))
        h = np.where(inside, h * _U(0x9DDFEA08EB382D69) + words[src], h)
        w += np.where(inside, weight[src], 0)
        got += inside
    h = mix(h)
    key = h + of.astype(_U) * _U(0xE7037ED1A0B428DB)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.empty(0, bool)
    once, times = order[new], np.diff(np.r_[np.flatnonzero(new), len(key)])
    w = (w[once] / got[once]) * times
    order = np.lexsort((h[once], of[once]))
    return of[once][order], h[once][order], w[order].astype(np.float32)


def _tables() -> tuple[np.ndarray, ...]:
    """r, 1/r and ln c (r, c of Gamma(2, 1)) and beta (uniform), each at the midpoints of 2**16 equal probabilities."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    lo, hi = np.zeros_like(p), np.full_like(p, 40.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    r = (lo + hi) / 2
    return r.astype(np.float32), (1 / r).astype(np.float32), np.log(r).astype(np.float32), p.astype(np.float32)


_SAMPLER: list[tuple[np.ndarray, ...]] = []


def samples(doc: np.ndarray, h: np.ndarray, w: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """k samples of each text as 64-bit values (n_docs x k); a text without shingles has zeros."""
    if not _SAMPLER:
        _SAMPLER.append(_tables())
    r, inv, ln_c, beta = _SAMPLER[0]
    out = np.zeros((n_docs, k), _U)
    has, starts = np.unique(doc, return_index=True)
    if not len(doc):
        return out
    sizes = np.diff(np.r_[starts, len(doc)])
    ln_w = np.log(w)
    for i in range(k):
        z = h * _U((2 * i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF | 1)
        z ^= z >> _U(29)
        z *= _U(0xBF58476D1CE4E5B9)
        bits = z.view(np.uint16).reshape(-1, 4)
        a, b = np.ascontiguousarray(bits[:, 3]), beta[bits[:, 1]]
        t = np.floor(ln_w * inv[a] + b)
        value = ln_c[bits[:, 2]] - r[a] * (t - b + np.float32(1))
        least = np.minimum.reduceat(value, starts)
        hit = np.flatnonzero(value == np.repeat(least, sizes))
        place, first = np.unique(np.searchsorted(starts, hit, "right") - 1, return_index=True)
        at = hit[first]
        out[has[place], i] = mix(h[at] + t[at].astype(np.int64).view(_U) * _U(0x9E3779B97F4A7C15) + _U(i))
    return out


def _sign(idf, size: int, bands: int, rows: int):
    """Arrow function (doc_id, text, text_hash) -> doc_id, text_hash, d0, d1 (digest of the words), n_words, keys (array), sig (16 bits a sample)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                buf, off = texts_of(part.column(1))
                words, of_word = _words(buf, off)
                n = np.bincount(of_word, minlength=part.num_rows)
                digest = []
                for mult in (0xD1342543DE82EF95, 0xA24BAED4963EE407):
                    place = (np.arange(len(words)) - (np.cumsum(n) - n)[of_word]).astype(_U)
                    x = mix((words + place * _U(mult)) * _U(mult | 1))
                    total = np.zeros(part.num_rows, _U)
                    np.add.at(total, of_word, x)
                    digest.append(total.view(np.int64))
                doc, h, w = shingles(buf, off, idf.value, size)
                got = samples(doc, h, w, part.num_rows, bands * rows)
                keys = got.reshape(part.num_rows, bands, rows)
                key = np.arange(bands, dtype=_U)[None, :] * _U(0x9E3779B97F4A7C15) + np.zeros((part.num_rows, 1), _U)
                for j in range(rows):
                    key = mix((key ^ keys[:, :, j]) * _U(0xD6E8FEB86659FD93) + _U(j))
                flat = pa.array(key.reshape(-1).view(np.int64))
                sig = (got & _U(0xFFFF)).astype("<u2")
                yield table({
                    "doc_id": part.column(0), "text_hash": part.column(2), "d0": pa.array(digest[0]), "d1": pa.array(digest[1]), "n_words": pa.array(n.astype(np.int64)),
                    "keys": pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * bands), flat),
                    "sig": pa.array([x.tobytes() for x in sig], pa.binary()),
                })

    return run


def _agree(k: int):
    """Arrow function (x, y, sx, sy) -> (x, y, share of equal samples)."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            both = [np.frombuffer(b"".join(b.column(i).to_pylist()), "<u2").reshape(-1, k) for i in (2, 3)]
            yield table({"x": b.column(0), "y": b.column(1), "share": pa.array((both[0] == both[1]).mean(axis=1))})

    return run


def _jaccard(a: np.ndarray, u: np.ndarray, c: np.ndarray, v: np.ndarray) -> float:
    """Weighted Jaccard similarity of two texts: shingles in ascending order with their weights."""
    if not len(a) or not len(c):
        return 0.0
    at = np.minimum(np.searchsorted(c, a), len(c) - 1)
    same = c[at] == a
    least = np.minimum(u[same], v[at[same]]).sum(dtype=float)
    return least / (u.sum(dtype=float) + v.sum(dtype=float) - least)


def _similarity(idf, size: int):
    """Arrow function (x, y, tx, ty) -> (x, y, similarity) of whole texts."""

    def run(batches):
        for b in batches:
            for part in slices(b, 2, 1 << 21):
                # each distinct text of the slice is parsed once, however many pairs it is in
                texts = pa.concat_arrays([part.column(2), part.column(3)]).dictionary_encode()
                doc, h, w = shingles(*texts_of(texts.dictionary), idf.value, size)
                at = np.searchsorted(doc, np.arange(len(texts.dictionary) + 1))
                x, y = texts.indices.to_numpy().reshape(2, -1)
                out = [_jaccard(h[at[i] : at[i + 1]], w[at[i] : at[i + 1]], h[at[j] : at[j + 1]], w[at[j] : at[j + 1]]) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
                yield table({"x": part.column(0), "y": part.column(1), "similarity": pa.array(out, pa.float64())})

    return run


def _open_groups(k: int, doubt: float, texts: tuple | None = None):
    """Arrow function over (key, i, j, side, id, class_id, keys, sig[, text]), sorted by key, i, j. Without texts -> the
    members (key, i, j, id) that have a likely pair; with texts = (idf, size, threshold) -> links (x, y).

    Compared are members of side 0 with those of side 1, or of side 0 with each other in a group that has no side 1, where
    their classes are unlike and the key is the first that they share, so that a pair is judged once. Links join classes
    as they are found: a pair that others have joined needs no link.
    """

    def judged(rows: pa.RecordBatch) -> pa.RecordBatch:
        key, i, j, side, ids = (rows.column(c).to_numpy(zero_copy_only=False) for c in range(5))
        cls = rows.column(5).to_numpy(zero_copy_only=False).copy()
        keys = rows.column(6).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        sig = np.frombuffer(b"".join(rows.column(7).to_pylist()), "<u2").reshape(-1, k)
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        parsed: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def of(at: int) -> tuple[np.ndarray, np.ndarray]:
            if at not in parsed:
                parsed[at] = shingles(*texts_of(rows.column(8).slice(at, 1)), texts[0].value, texts[1])[1:]
            return parsed[at]

        needed, links = np.zeros(rows.num_rows, bool), []
        for lo, hi in zip(starts, [*starts[1:], rows.num_rows], strict=True):
            parsed.clear()
            left, right = lo + np.flatnonzero(side[lo:hi] == 0), lo + np.flatnonzero(side[lo:hi] == 1)
            for n, a in enumerate(left.tolist()):
                b = right if len(right) else left[n + 1 :]
                b = b[cls[b] != cls[a]]
                b = b[(sig[b] == sig[a]).mean(axis=1) >= doubt]
                b = b[keys[b, (keys[b] == keys[a]).argmax(axis=1)] == key[lo]] if len(b) else b
                if not texts:
                    needed[b] = True
                    needed[a] |= len(b) > 0
                    continue
                for c in b.tolist():
                    if cls[a] != cls[c] and _jaccard(*of(a), *of(c)) >= texts[2]:
                        links.append((int(ids[a]), int(ids[c])))
                        cls[cls == cls[c]] = cls[a]
        if texts:
            return table({"x": pa.array([x for x, _ in links], pa.int64()), "y": pa.array([y for _, y in links], pa.int64())})
        return table({"key": pa.array(key[needed]), "i": pa.array(i[needed]), "j": pa.array(j[needed]), "id": pa.array(ids[needed])})

    def run(batches):
        held: list[pa.RecordBatch] = []  # the batches since the last group's start
        for b in batches:
            if not b.num_rows:
                continue
            mark = [b.column(c).to_numpy(zero_copy_only=False) for c in range(3)]
            cuts = (np.flatnonzero((mark[0][1:] != mark[0][:-1]) | (mark[1][1:] != mark[1][:-1]) | (mark[2][1:] != mark[2][:-1])) + 1).tolist()
            if held and any(held[-1].column(c)[held[-1].num_rows - 1].as_py() != mark[c][0] for c in range(3)):
                cuts = [0, *cuts]
            if not cuts:
                held.append(b)
                continue
            whole = [*held, b.slice(0, cuts[-1])]
            if sum(x.num_rows for x in whole):
                yield judged(pa.concat_batches(whole))
            held = [b.slice(cuts[-1])]
        if held:
            yield judged(pa.concat_batches(held))

    return run


def near_duplicates(docs: DataFrame, threshold: float = 0.8, size: int = 5, bands: int = 21, rows: int = 3, doubt: float = 0.55) -> DataFrame:
    """docs(doc_id, text) -> doc_id, text_hash, class_id, kept: one row per row of docs.

    class_id is the least doc_id of the class; kept marks the document that stays for it. Rows without a word (null,
    empty or blank texts) are alike to nothing: each is kept, with its own doc_id as class_id. Rows with a null doc_id
    are kept, with a null class_id, and join no class. Repeated rows are one document written twice and fare alike; a
    doc_id that comes with several texts has, in each row, the class of that row's text. An empty table gives an empty
    table; other columns are ignored. A link at the threshold is missed with a probability of (1 - threshold**rows)**bands
    by its keys and of about as much by `doubt`: together under 0.000001 by default.
    """
    spark = docs.sparkSession
    text_batches(spark)
    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    known = docs.where(F.col("doc_id").isNotNull())
    idf = spark.sparkContext.broadcast(idf_table(docs))
    signed = written(known.mapInArrow(_sign(idf, size, bands, rows), "doc_id long, text_hash long, d0 long, d1 long, n_words long, keys array<long>, sig binary"), "signed")
    alike = signed.where("n_words > 0").groupBy("d0", "d1").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"))
    # a number per distinct text, in order of its least doc_id: a class's least number is that of its least doc_id
    alike = written(ranked(alike.select("d0", "d1", F.col("least.doc_id").alias("rep"), F.col("least.text_hash").alias("rep_hash")), [F.col("rep"), F.col("d0"), F.col("d1")], "id"), "alike")
    merged = _classes(known, signed, alike, idf, threshold, size, bands * rows, doubt)
    release(spark)
    first = merged.join(alike.select(F.col("id").alias("class_id"), F.col("rep").alias("first")), "class_id").select("id", "first")
    named = alike.join(first, "id", "left").select("d0", "d1", F.coalesce("first", "rep").alias("class_id"))
    classed = signed.select("doc_id", "text_hash", "d0", "d1").join(named, ["d0", "d1"], "left")
    classed = classed.select("doc_id", "text_hash", F.coalesce("class_id", "doc_id").alias("class_id"))
    unknown = docs.where(F.col("doc_id").isNull()).select("doc_id", "text_hash", F.lit(None).cast("long").alias("class_id"))
    return classed.unionByName(unknown).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


#: Members of a key's group in one block, and their words together, on average.
BLOCK, BLOCK_WORDS = 256, 500_000


def _beside(pairs: DataFrame, table_of: DataFrame, what: str) -> DataFrame:
    """Written pairs(x, y) with column `what` of table_of(id, what) for both, as what_x and what_y. One id may be in any
    share of the pairs."""
    hot = {c: hot_keys(pairs.groupBy(c).agg(F.count("*").alias("n")), c) for c in "xy"}
    for here, there in (("x", "y"), ("y", "x")):
        pairs = heavy_join(pairs, table_of.select(F.col("id").alias(here), F.col(what).alias(f"{what}_{here}")), here, there, hot[here])
    return pairs.select("x", "y", f"{what}_x", f"{what}_y")


def _classes(known: DataFrame, signed: DataFrame, alike: DataFrame, idf, threshold: float, size: int, k: int, doubt: float) -> DataFrame:
    """(id, class_id) of the numbers of distinct texts that have a verified link; alike(id, d0, d1, rep, rep_hash)."""
    spark = known.sparkSession
    one = signed.where("n_words > 0").join(alike.toDF("d0", "d1", "doc_id", "text_hash", "id"), ["d0", "d1", "doc_id", "text_hash"]).select("id", "n_words", "keys", "sig")
    one = written(one.dropDuplicates(["id"]), "distinct")
    keys = one.select("id", F.explode("keys").alias("key"))
    shared = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    hot = hot_keys(shared, "key")
    groups = written(heavy_join(keys, shared, "key", "id", hot), "groups")
    standing = groups.groupBy("id").agg(F.sum("n").alias("standing"))
    centres = groups.join(standing, "id").groupBy("key").agg(F.max_by("id", F.struct("standing", -F.col("id"))).alias("centre"))
    groups = written(heavy_join(groups.select("key", "id"), centres, "key", "id", hot), "centred")
    who = written(groups.select("id").distinct(), "members")
    sigs = written(one.join(who, "id"), "sigs")
    rep = alike.select("id", F.col("rep").alias("doc_id"), F.col("rep_hash").alias("text_hash")).join(who, "id")
    texts = written(known.join(rep, ["doc_id", "text_hash"]).dropDuplicates(["id"]).select("id", "text"), "texts")
    release(spark)

    first = written(groups.where("id <> centre").select(F.col("id").alias("x"), F.col("centre").alias("y")).distinct(), "first")
    agreed = _beside(first, sigs, "sig").mapInArrow(_agree(k), "x long, y long, share double")
    likely = written(agreed.where(F.col("share") >= doubt).select("x", "y"), "likely")
    sure = _beside(likely, texts, "text").mapInArrow(_similarity(idf, size), "x long, y long, similarity double")
    links = written(sure.where(F.col("similarity") >= threshold).select("x", "y"), "links")
    labels = components(links)
    release(spark)
    sizes = sigs.select("id", "n_words")
    now = groups.select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("class_id", "id").alias("class_id")).join(sizes, "id")
    now = written(now, "now")
    per = now.groupBy("key", "class_id").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))
    per = per.groupBy("key").agg(F.max_by("class_id", F.struct("n", "class_id")).alias("main"), F.max(F.struct("n", "class_id", "words")).alias("m"), F.sum("n").alias("n"), F.sum("words").alias("words"), F.count("*").alias("k"))
    blocks = lambda n, words: F.greatest(F.ceil(n / BLOCK), F.ceil(words / BLOCK_WORDS)).cast("int")
    apart = per.where("k > 1").select("key", "main", blocks(F.col("m.n"), F.col("m.words")).alias("mains"), blocks(F.col("n") - F.col("m.n"), F.col("words") - F.col("m.words")).alias("opens"))
    dealt = heavy_join(now, apart, "key", "id", hot).withColumn("is_open", F.col("class_id") != F.col("main"))
    own = F.pmod(F.hash("id"), F.when(F.col("is_open"), F.col("opens")).otherwise(F.col("mains")))
    place = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    # groups: open block i with main block j; open block i with open block -1 - j
    each = lambda n, body: F.transform(F.sequence(F.lit(0), n - 1), body)
    with_open = each(F.col("opens"), lambda o: F.when(F.col("own") <= o, place(F.col("own"), -1 - o, 0)).otherwise(place(o, -1 - F.col("own"), 1)))
    places = F.when(F.col("is_open"), F.concat(each(F.col("mains"), lambda m: place(F.col("own"), m, 0)), with_open)).otherwise(each(F.col("opens"), lambda o: place(o, F.col("own"), 1)))
    dealt = dealt.withColumn("own", own).select("key", "id", "class_id", F.explode(places).alias("p")).select("key", "p.*", "id", "class_id")
    dealt = written(dealt, "dealt")
    full = dealt.join(sigs.select("id", "keys", "sig"), "id").select("key", "i", "j", "side", "id", "class_id", "keys", "sig")
    needed = written(full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_open_groups(k, doubt), "key long, i int, j int, id long"), "needed")
    if not needed.limit(1).count():
        return labels
    full = dealt.join(needed, ["key", "i", "j", "id"]).join(sigs.select("id", "keys", "sig"), "id")
    full = heavy_join(full, texts, "id", "key").select("key", "i", "j", "side", "id", "class_id", "keys", "sig", "text")
    more = written(full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_open_groups(k, doubt, (idf, size, threshold)), "x long, y long"), "links")
    return components(links.unionByName(more)) if more.limit(1).count() else labels


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document: five words, similarity 0.8 or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).drop("text_hash")
