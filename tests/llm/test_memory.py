"""What the pipeline's Arrow functions hold at once, and how large the batches are that they give back."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from stemma.llm import bytescan, near_dup, packing, suffix_dedup
from stemma.llm.decontaminate import _through, build, item_words
from stemma.llm.encode import encoder

TEXTS, BYTES = 80, 50_000


def batch(texts=None):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(5000)]
    texts = texts or [" ".join(rng.choices(words, k=BYTES // 7)) for _ in range(TEXTS)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["ord", "text"])


def with_parts(rows):
    """The rows with all of their windows open."""
    n = np.array(pa.compute.binary_length(rows.column(1)), np.int32) - 99
    runs = pa.StructArray.from_arrays([pa.array(np.zeros(len(n), np.int64)), pa.array(n)], ["start", "n"])
    return pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32)), runs)], names=["ord", "text", "parts"])


def encoded(batches):
    for b in batches:
        for part in bytescan.slices(b, 1, packing.SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(encoder("word_bpe_49k.json").batch(part.column(1)), pa.binary())], names=["ids"])


def through(tmp_path):
    build([item_words("one two three four")], ["x"], 13).save(f"file://{tmp_path}/0.npz", "0")
    return _through([f"file://{tmp_path}/0.npz"])


@pytest.mark.parametrize("what", ["stretches", "ranks", "words", "decontaminate", "packing"])
def test_memory_of_a_batch(what, tmp_path):
    rows = batch()
    run, rows = {
        "stretches": lambda: (suffix_dedup.stretches(100, 50, 20), rows),
        "ranks": lambda: (suffix_dedup.ranks(100, 20, 0), with_parts(rows)),
        "words": lambda: (near_dup._count_words, rows.select(["text"])),
        "decontaminate": lambda: (through(tmp_path), rows),
        "packing": lambda: (encoded, rows),
    }[what]()
    list(run(iter([rows.slice(0, 2)])))  # tables that a worker keeps
    tracemalloc.start()
    try:
        largest = max(out.nbytes for out in run(iter([rows])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 64 << 20, f"{peak >> 20} MB"
    assert largest < 8 << 20


@pytest.mark.parametrize("what", ["stretches", "ranks"])
def test_one_long_text_comes_back_in_small_batches(what, monkeypatch):
    monkeypatch.setattr("stemma.llm.files.MOST_ROWS", 1 << 14)
    rng = random.Random(5)
    text = "".join(rng.choices("abcdefghij \n", k=700_000))
    rows = batch([text, text[:300]])
    run, rows = (suffix_dedup.stretches(100, 50, 20), rows) if what == "stretches" else (suffix_dedup.ranks(100, 20, 0), with_parts(rows))
    got = list(run(iter([rows])))
    alone = [b for i in range(2) for b in run(iter([rows.slice(i, 1)]))]
    listed = lambda out: sorted(pa.Table.from_batches(out).to_pylist(), key=lambda r: r["pos"])
    assert max(b.num_rows for b in got) <= 1 << 14 < sum(b.num_rows for b in got)
    assert listed(got) == listed(alone)
