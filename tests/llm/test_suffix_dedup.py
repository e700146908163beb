import hashlib
import random
import uuid

import numpy as np
import pyarrow as pa
import pytest

from stemma.llm import common, suffix_dedup
from stemma.llm.bytescan import hashes_at, window_hashes
from stemma.llm.files import table
from stemma.llm.suffix_dedup import deduplicated, doubled, without


def brute(rows, length):
    """(doc_id, text) in order -> removed count, spans and digest by a set of all strings."""
    seen, out = {}, []
    for place, (_, text) in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first = seen.setdefault(w, (place, p))
            if first != (place, p):
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, rows, length, seed):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, TEXT string")
    got = sorted(tuple(r) for r in deduplicated(df, length, seed).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    order = sorted(rows, key=lambda r: r[0])
    assert got == sorted((r[0], *x) for r, x in zip(order, brute(list(enumerate(order)), length), strict=True))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_texts(spark, seed):
    rng = random.Random(seed)
    words = ["alpha", "bé", "gamma", "δδ", "e", "漢字"]
    base = [" ".join(rng.choices(words, k=40)) for _ in range(4)]
    rows = []
    for i in range(60):
        t = rng.choice(base)
        cut = rng.randrange(len(t))
        rows.append((i * 3 + 1, t[:cut] + rng.choice(["", "ZZ", " extra"]) + t[rng.randrange(len(t)) :] + " ".join(rng.choices(words, k=rng.randrange(30)))))
    rows += [(500, ""), (501, None), (502, "a" * 300), (503, "a" * 90 + "b"), (504, "ab" * 200), (-5, base[0]), (600, base[0] * 3)]
    check(spark, rows, 20, 10)


def test_hot_copies_and_long_text(spark):
    rng = random.Random(9)
    t = " ".join(str(rng.random()) for _ in range(50))
    rows = [(i, t if i % 3 else t[:200] + str(i) + t[200:]) for i in range(200)] + [(1000, t * 40)]
    check(spark, rows, 100, 50)


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "x" * 10 + "0123456789abcdef" * 4), (1, "x" * 10 + "0123456789abcdef" * 4), (None, "q" + "zyxwvutsrqponmlkji"), (2, "zyxwvutsrqponmlkji")], "doc_id long, text string")
    got = {(r.doc_id, r.n_removed) for r in deduplicated(df, 18, 9).collect()}
    # rows alike don't repeat each other; the null doc_id comes first
    assert (2, 18) in got and (None, 0) in got and len({r for r in got if r[0] == 1}) == 1


@pytest.mark.parametrize("batch", [1, 3, 50])
def test_one_round_of_doubling(spark, batch):
    rng = random.Random(batch)
    rows = [(rng.choice([0, 0, 0, 5, i]), rng.choice([1, 1, -i]), i * 2, i, -i) for i in range(400)] + [(7, 7, 1, 0, 0), (7, 7, 1, 0, 0)]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, batch)
    got = sorted(tuple(r) for r in doubled(spark.createDataFrame(rows, "a long, b long, pos long, c long, d long").repartition(5)).collect())
    spark.conf.set(name, was)
    runs = {}
    for r in rows:
        runs.setdefault(r[:2], []).append(r)
    assert got == sorted((min(x[2] for x in v), *r[2:]) for v in runs.values() if len(v) > 1 for r in v)


def test_large_ids_and_empty_table(spark):
    rows = [(-(1 << 62), "0123456789abcdefghij"), (1 << 62, "0123456789abcdefghij!")]
    check(spark, rows, 20, 10)
    assert deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_round_carries_no_more_columns_than_it_needs(spark):
    rows = [(1, 1, 10), (1, 1, 4), (2, 1, 5), (2, 2, 6), (2, 2, 7), (2, 2, 3)]
    got = doubled(spark.createDataFrame(rows, "a long, b long, pos long").repartition(3))
    assert got.columns == ["rank", "pos"] and sorted(tuple(r) for r in got.collect()) == [(3, 3), (3, 6), (3, 7), (4, 4), (4, 10)]


def test_replaced_tables_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _, what: f"file://{tmp_path}/{what}-{uuid.uuid4().hex}")
    text = "".join(chr(97 + i * i % 23) for i in range(400))
    check(spark, [(i, text[i:] + str(i) + text) for i in range(30)], 40, 20)
    assert sorted(p.name.split("-")[0] for p in tmp_path.iterdir()) == ["ranks", "ranks", "stretches"]


def test_fingerprints_at_places_are_those_of_all_windows():
    rng = np.random.default_rng(5)
    buf = rng.integers(0, 256, 200_000).astype(np.uint8)
    for k in (1, 25, 50, 512):
        last = len(buf) - k
        start = np.sort(np.r_[rng.integers(0, last + 1, 3000), 0, 0, 65535, 65536, last])
        assert (hashes_at(buf, start, k) == window_hashes(buf, k)[start]).all()
    assert len(hashes_at(buf, np.empty(0, np.int64), 25)) == 0


def test_spans_are_cut_out_of_many_texts_at_once():
    rng = random.Random(6)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for _ in range(500):
        texts = [bytes(rng.choices(b"abc", k=rng.choice([0, 0, 1, 5, 30]))) for _ in range(rng.randrange(1, 8))]
        cuts = [sorted((a, rng.randrange(a, len(t)) + 1) for a in rng.choices(range(len(t)), k=rng.choice([0, 1, 2, 6]))) if t else None for t in texts]
        spans = [None if c is None else [{"start": a, "end": b} for a, b in c] for c in cuts]
        arrow = pa.array([[{"start": 0, "end": 7}], *spans], kind).slice(1)
        kept, off, runs = suffix_dedup.cut_out(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), arrow)
        assert [(kept[lo:hi].tobytes(), n) for lo, hi, n in zip(off[:-1], off[1:], runs, strict=True)] == [without(t, s or []) for t, s in zip(texts, spans, strict=True)]


def test_no_step_per_span_and_no_fingerprint_of_windows_that_are_not_asked_for(monkeypatch):
    # each of these cost CPU time on all spans, or on all bytes
    monkeypatch.setattr(suffix_dedup, "without", None)
    monkeypatch.setattr(suffix_dedup, "window_hashes", None)
    text = "".join(chr(97 + i * i % 23) for i in range(300))
    spans = pa.array([[{"start": i, "end": i + 100} for i in range(150)]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    (kept,) = suffix_dedup._keep([table({"doc_id": pa.array([1]), "text": pa.array([text]), "spans": spans})])
    assert kept.column(4).to_pylist() == [text[249:].encode()] and kept.column(2).to_pylist() == [249] and kept.column(3).to_pylist() == [1]
    parts = pa.array([[{"start": 120, "n": 30}, {"start": 7, "n": 5}]], pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int32())])))
    pos = [p for share in range(suffix_dedup.SHARES) for b in suffix_dedup.ranks(100, 10, share)([table({"ord": pa.array([3]), "text": pa.array([text]), "parts": parts})]) for p in b.column(2).to_pylist()]
    assert sorted(pos) == [3 << 10 | i for i in (*range(7, 12), *range(120, 150))]


def test_judged_rows_carry_keys_only_while_they_are_open():
    rows = [(1, 1, 5, 1), (1, 2, 6, 1), (2, 1, 7, 1), (2, 1, 8, 1), (2, 3, 9, 1), (3, 1, 2, 1), (3, 1, 3, 1)]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
    batch = table({c: pa.array(x, t) for c, x, t in zip(("a", "b", "pos", "n"), zip(*rows, strict=True), kinds, strict=True)})
    got = {(r["kind"], r["a"], r["b"], r["pos"]) for b in suffix_dedup._runs([batch]) for r in b.to_pylist()}
    closed = {(suffix_dedup.DUP, None, None, 8), (suffix_dedup.DUP, None, None, 3), (suffix_dedup.PART, None, None, 7), (suffix_dedup.PART, None, None, 9)}
    assert got == closed | {(suffix_dedup.OPEN, 1, 1, 5), (suffix_dedup.OPEN, 1, 2, 6), (suffix_dedup.OPEN, 3, 1, 2)}


@pytest.mark.parametrize("batch", [1, 3, 50])
def test_windows_that_touch_become_one_run(batch):
    rng, length = random.Random(batch), 5
    base = (1 << 62) + 1  # beyond what a double holds exactly
    rows = sorted({(base + (rng.randrange(3) << 10) + rng.randrange(60), rng.randrange(1, 4)) for _ in range(30)})
    pos, n = (np.array(x) for x in zip(*rows, strict=True))
    batches = [table({"pos": pa.array(pos[i : i + batch]), "n": pa.array(n[i : i + batch].astype(np.int32))}) for i in range(0, len(pos), batch)]
    got = [(r["pos"], r["pos"] + r["n"] - 1 + length) for b in suffix_dedup._united(length)(iter(batches)) for r in b.to_pylist()]
    assert {p for lo, hi in got for p in range(lo, hi)} == {p for a, k in rows for p in range(a, a + k - 1 + length)}
    assert all(hi < lo for (_, hi), (lo, _) in zip(got[:-1], got[1:], strict=True))


def test_a_text_brings_no_span_for_each_of_its_windows(spark):
    rng = random.Random(9)
    passages = ["".join(rng.choices("abcdefgh ", k=400)) for _ in range(3)]
    rows = [(i, f"{i}{rng.random()}".join(rng.sample(passages, 3))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts = [len(r.spans) for r in suffix_dedup.removed_spans(docs, 100).select("spans").collect()]
    # three passages each, and a run parted at the ends of the partitions
    assert sum(counts) <= 3 * len(rows) + 8
    check(spark, rows, 100, 50)
