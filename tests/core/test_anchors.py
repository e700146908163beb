import random
import re

import numpy as np
import pytest

from stemma.operators import anchors as A


def overlapping(text, patterns):
    return sorted((i, len(p), k) for k, p in enumerate(patterns) if p for i in range(len(text) - len(p) + 1) if text[i : i + len(p)] == p)


@pytest.mark.parametrize("seed", range(6))
def test_all_occurrences(monkeypatch, seed):
    monkeypatch.setattr(A, "LANE", 7)
    r = random.Random(seed)
    word = lambda n: bytes(r.choice(b"abc") for _ in range(n))
    patterns = list(dict.fromkeys(word(r.randrange(1, 6)) for _ in range(12)))
    texts = [word(r.randrange(0, 60)) for _ in range(20)] + [b"", b"xyz", b"a"]
    off = np.r_[0, np.cumsum([len(t) for t in texts])]
    start, length, number = A.Automaton(patterns).occurrences(np.frombuffer(b"".join(texts), np.uint8), off)
    got = [[] for _ in texts]
    for s, n, k in zip(start.tolist(), length.tolist(), number.tolist(), strict=True):
        t = int(np.searchsorted(off, s, "right")) - 1
        got[t].append((s - int(off[t]), n, k))
    assert [sorted(x) for x in got] == [overlapping(t, patterns) for t in texts]


def split(text, terms):
    """By one alternation of all terms, longest first."""
    out, last = [], 0
    for m in re.finditer("|".join(map(re.escape, sorted(terms, key=lambda t: (-len(t), t)))), text or ""):
        if m.start() > last:
            out.append(("text", text[last : m.start()], None))
        out.append(("anchor", m[0], terms[m[0]]))
        last = m.end()
    return out + ([("text", text[last:], None)] if last < len(text or "") else [])


@pytest.mark.parametrize("size", [1 << 16, 12])
def test_split(spark, monkeypatch, size):
    """Also with terms over many automata."""
    monkeypatch.setattr(A, "AUTOMATON_BYTES", size)
    terms = {"定理 2.1": 1, "定理 2": 2, "Cauchy": 3, "Cauchy sequence": 4, "sequence": 5, "aa": 6, "aaa": 7, "x+y*": 8, "(z)": 9}
    texts = ["由定理 2.1 和定理 2 可知", "a Cauchy sequence; sequences; cauchy", "aaaaaaaa", "x+y*(z)", None, "", "none", "Cauchy" * 2000, "é定理 2é"]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(0, texts[0], "k")], "id long, text string, place_2 string")
    got = A.split_by_anchors(df, spark.createDataFrame([*terms.items(), ("aa", 60), ("", 5)], "term string, node long"))
    assert got.columns == ["id", "place_2", "place", "kind", "src", "node"]
    rows = {}
    for r in got.collect():
        rows.setdefault(r.id, []).append((r.place, r.kind, r.src, r.node))
    for i, t in enumerate(texts):
        want = [(k, *x) for k, x in enumerate(split(t, terms))]
        assert sorted(rows.get(i, []), key=str) == sorted(want * (2 if i == 0 else 1), key=str)


def test_split_without_terms_or_texts(spark):
    df = spark.createDataFrame([(1, "abc")], "id long, text string")
    none = spark.createDataFrame([], "term string, node long")
    assert [tuple(r) for r in A.split_by_anchors(df, none).collect()] == [(1, 0, "text", "abc", None)]
    assert A.split_by_anchors(df.limit(0), none).count() == 0


def test_first_owner_has_the_name(spark):
    schema = "id long, pos long, label string, title_zh string, title_en string, terms array<string>"
    rows = [
        (7, 2, "Theorem 3.1", "中值定理", "Mean", ["mean VALUE", "abc"]), (8, 1, "theorem 3.1", "定理", "MEAN", None), (9, 3, "Lemma", "  引理二 ", "Of", ["定理", "mean value", "long phrase"]), (1, 9, None, None, None, []),
    ]
    got = {r.key: (r.term, r.node, r.place.length) for r in A.text_anchors(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        "theorem 3.1": ("theorem 3.1", 8, 11), "mean": ("MEAN", 8, 4), "中值定理": ("中值定理", 7, 4), "mean value": ("mean VALUE", 7, 10), "引理二": ("引理二", 9, 3), "long phrase": ("long phrase", 9, 11),
    }
