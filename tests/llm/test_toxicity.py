import random
import zlib
from itertools import combinations

import numpy as np
import pytest

from stemma.llm import toxicity as T

SCHEMA = "doc_id long, text string, lang string, TEXT_2 string"


def kernel(a, b, order):
    """The gap-weighted subsequence kernel by its definition."""
    def parts(w):
        out = {}
        s = [int(T._SYMBOL[c]) for c in w]
        for at in combinations(range(len(s)), order):
            if all(s[i] for i in at):
                key = tuple(s[i] for i in at)
                out[key] = out.get(key, 0.0) + T.DECAY ** (at[-1] - at[0] + 1)
        return out

    x, y = parts(a), parts(b)
    return sum(v * y.get(k, 0.0) for k, v in x.items())


def mean_kernel(a, b):
    out = 0.0
    for k in T.ORDERS:
        norm = (kernel(a, a, k) * kernel(b, b, k)) ** 0.5
        out += (kernel(a, b, k) / norm if norm else 0.0) / len(T.ORDERS)
    return out


WORDS = [b"idiot", b"id-iot", b"idxiot", b"aaaa", b"aaaaaa", b"ab", b"abc", b"x.y.z.w", "hällo".encode(), b"1d10t", b"abcabcabcabcabca", b"----"]


def test_kernels_by_their_definition():
    marks = T.Landmarks(WORDS[:6])
    got = marks.kernels(*(lambda b, s, e: (b, s, e - s))(*T.packed(WORDS)))
    want = np.array([[mean_kernel(a, b) for b in WORDS[:6]] for a in WORDS])
    assert np.allclose(got, want, atol=1e-5)
    assert got[1, 0] > 0.9 and got[2, 0] > 0.5 and got[9, 0] > 0.99


def test_tables_are_the_decision():
    marks = T.Landmarks(WORDS[:8])
    w = np.random.default_rng(1).normal(size=8)
    model = T.Model(marks.tables(w), 0.25)
    assert np.allclose(model.words(*T.packed(WORDS)), marks.features(WORDS) @ w + 0.25, atol=1e-4)


def test_long_words_by_windows():
    marks = T.Landmarks([b"idiot", b"moron"])
    model = T.Model(marks.tables(np.array([1.0, 0.2])), 0.0)
    long = b"q" * 30 + b"idiot" + b"z" * 41
    parts = [long[i : i + T.WINDOW] for i in range(0, len(long), T.WINDOW // 2)]
    assert abs(model.words(*T.packed([long]))[0] - model.words(*T.packed(parts)).max()) < 1e-5


CLEAN = ["the", "river", "stone", "walks", "over", "green", "hills", "many", "people", "idea", "morning", "under", "table", "count", "story"]
INSULTS = ["idiot", "moron", "scumbag"]


def some_docs(n, seed=3):
    r = random.Random(seed)
    rows, toxic = [], {}
    for i in range(n):
        words = r.choices(CLEAN, k=r.randrange(4, 40))
        toxic[i] = int(r.random() < 0.25)
        if toxic[i]:
            words.insert(r.randrange(len(words)), r.choice(INSULTS))
        rows.append((i, " ".join(words).capitalize() + ".", "en", "x"))
    return rows, [(i, 1, t) for i, t in toxic.items()]


def test_held_out_and_planted(spark):
    rows, labels = some_docs(400)
    planted = {1000: "You are such an idi-ot my friend.", 1001: "What a m.o.r.o.n he is. Walks over hills.", 1002: "The i d i o t walks. Green hills.", 1003: "scumxbag people", 1004: "IDIOT!", 1005: "1d1ot people", 1006: "walks " * 200_000 + "moron"}
    clean = {2000: "Green hills. Many stones.", 2001: "", 2002: None, 2003: " \n ... 123 !", 2004: "morning idea " * 100_000}
    more = [(i, t, "en", "x") for i, t in (planted | clean).items()] + [(None, "an idiot", None, None), (None, None, None, None), (1004, "IDIOT!", "fr", "z")]
    docs = spark.createDataFrame(rows + more, SCHEMA).repartition(6)
    got = T.toxicity(docs, spark.createDataFrame([*labels, (None, 1, 1), (5000, 0, None), (0, 0, 0)], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows) + len(more)
    by_id = {r.doc_id: r for r in got}
    truth = {i: t for i, _, t in labels}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and all(r.predicted == truth[r.doc_id] for r in held)
    assert {i: by_id[i].predicted for i in planted} == dict.fromkeys(planted, 1)
    assert {i: by_id[i].predicted for i in clean} == dict.fromkeys(clean, 0)
    assert {r.score for r in got if r.doc_id in (2001, 2002)} == {min(r.score for r in got)}
    assert by_id[1001].word == "m.o.r.o.n" and planted[1001].encode()[by_id[1001].start : by_id[1001].end] == b"What a m.o.r.o.n he is."
    assert len({r.score for r in got if r.doc_id == 1004}) == 1 and sum(r.doc_id == 1004 for r in got) == 2


def test_labels_are_no_input(spark):
    """Held-out labels, and everything but the text, leave scores as they are."""
    rows, labels = some_docs(200, 5)
    docs = spark.createDataFrame(rows, SCHEMA)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    one, two = (sorted((r.doc_id, r.score) for r in T.toxicity(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (labels, flipped))
    assert one == two


@pytest.mark.parametrize("labels,score", [([], 0.0), ([(0, 1, 0), (1, 1, 0)], 0.0), ([(1, 1, 1), (2, 1, 1)], 1.0)])
def test_without_labels_of_both_kinds(spark, labels, score):
    docs = spark.createDataFrame([(1, "an idiot", "en", ""), (2, None, "en", "")], SCHEMA)
    got = T.toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert [round(r.score, 3) for r in got] == [score] * 2


def test_empty_table(spark):
    assert T.toxicity(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")).count() == 0


def test_query(spark):
    got = T.op13_toxicity(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = got.join(labels, "doc_id").collect()
    caught = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert sum(caught) / len(caught) > 0.7 and sum(clean) / len(clean) < 0.1
