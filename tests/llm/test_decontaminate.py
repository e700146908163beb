import hashlib
import random
import re

import numpy as np

import stemma.llm.decontaminate as module
from stemma.llm.decontaminate import Automaton, build, contamination

PATTERN = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window, share=20):
    ws, hit, found = words(text), set(), set()
    for item_id, t in items:
        iw = words(t)
        n = min(window, len(iw))
        if not n:
            continue
        for j in range(len(iw) - n + 1):
            for i in range(len(ws) - n + 1):
                if ws[i : i + n] == iw[j : j + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(item_id))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(ws), len(hit), len(found), digest, bool(hit) and share * len(hit) >= len(ws)


def cases(seed):
    rng = random.Random(seed)
    vocab = ["a", "B", "c9", "dé", "É", "f"]
    text = lambda n: rng.choice(["", "- "]) + rng.choice([" ", ", ", "\n"]).join(rng.choices(vocab, k=n))
    items = [(i, text(rng.randrange(12))) for i in range(25)] + [(90, None), (91, ""), (92, "zz"), (92, "a B c9"), (93, "B"), (94, "... ")]
    docs = [(i, " ".join([text(rng.randrange(20)), rng.choice(items)[1] or "", text(rng.randrange(20))])) for i in range(60)]
    return items, [*docs, (100, None), (101, ""), (102, "..."), (None, "zz"), (103, "zz")]


def test_automaton_against_brute_force(spark, monkeypatch):
    for seed, window in ((1, 4), (2, 2), (3, 13)):
        items, docs = cases(seed)
        df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, Text string")
        bench = spark.createDataFrame([(*i, 1) for i in items], "item_id int, text string, ITEM_ID int")
        got = contamination(df, bench, window)
        rows = {tuple(r) for r in got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()}
        assert rows == {(d, *brute(t, items, window)) for d, t in docs}
        with monkeypatch.context() as m:  # several shards
            m.setattr(module, "SHARD_WORDS", 9)
            parts = contamination(df, bench, window)
            assert {tuple(r) for r in parts.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()} == rows


def test_spans_are_the_hit_words(spark):
    df = spark.createDataFrame([(1, "é x one TWO three y one two three")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three")], "item_id int, text string")
    row = contamination(df, bench).first()
    raw = "é x one TWO three y one two three".encode()
    assert [raw[s.start : s.end] for s in row.spans] == [b"one TWO three", b"one two three"]


def test_longest_match_states(tmp_path):
    build([[b"a", b"b", b"a", b"b", b"c"], [b"b", b"a", b"b"]], ["x", "y"], 3).save(f"file://{tmp_path}/a.npz", "1")
    a = Automaton.load(f"file://{tmp_path}/a.npz")
    assert a.words.to_pylist() == [b"a", b"b", b"c"] and a.names == ["x", "y"]
    hit, items = np.zeros(4, bool), set()
    a.reader().stream([1, 0, 1, 2], hit, items)  # b a b c
    assert items == {0, 1} and hit.all()
    assert a.reader().runs(np.array([1, 0, 1, -1, 2, 2, 1, 0, 1]), np.array([0] * 9)) == [(0, 3), (6, 9)]


def test_long_text_and_words_alike_in_hash(spark):
    bits = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = bits.translate({97: "b", 98: "a"})
    df = spark.createDataFrame([(1, f"x {other} y"), (2, f"x {bits} y"), (3, "one two " * 300_000)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit) for r in contamination(df, spark.createDataFrame([(1, bits), (2, "two one two")], "item_id int, text string")).collect()}
    assert got == {1: (3, 0), 2: (3, 1), 3: (600_000, 599_999)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id int, text string")
    assert contamination(none, bench).count() == 0
    assert contamination(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), bench).first().n_words == 2
