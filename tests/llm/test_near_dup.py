import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from stemma.llm.graph import components
from stemma.llm.near_dup import _words, idf_table, near_duplicates, samples


def split(text):
    return [w for w in re.split("[\x00-\x20]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def classes(rows, idf, threshold=0.8, size=5):
    """Brute force over all pairs of texts: weighted Jaccard links, then the least doc_id of each component."""

    def weight(word):
        raw = word.encode()
        h, _ = _words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        return float(idf[int(h[0] >> np.uint64(44))])

    bags = []
    for _, text in rows:
        ws = split(text)
        grams = [tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)] or ([tuple(ws)] if ws else [])
        bags.append({g: n * float(np.mean([weight(w) for w in g])) for g, n in Counter(grams).items()})
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            least = sum(min(v, bags[j][g]) for g, v in bags[i].items() if g in bags[j])
            union = sum(bags[i].values()) + sum(bags[j].values()) - least
            if union and least / union >= threshold:
                parent[find(i)] = find(j)
    roots = [find(i) for i in range(len(rows))]
    return {rows[i][0]: min(rows[j][0] for j in range(len(rows)) if roots[j] == roots[i]) for i in range(len(rows))}


def texts(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    bases = [rng.choices(vocab, k=rng.randrange(30, 120)) for _ in range(8)]
    rows = []
    for i in range(n):
        ws = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 8])):
            ws[rng.randrange(len(ws))] = rng.choice(vocab)
        rows.append((1000 - i, rng.choice([" ", "\n"]).join(ws).upper() if i % 7 == 0 else " ".join(ws)))
    return rows


def test_against_all_pairs(spark):
    rows = texts(1, 150) + [(2000, "one two"), (2001, "ONE  two"), (2002, "one three")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, DOC_ID string")
    idf = idf_table(df.toDF("doc_id", "text", "other"))
    got = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    assert got == classes(rows, idf)


def test_wordless_null_and_repeated_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "A b c d e F"), (6, "a b c d e f")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.class_id, r.kept) for r in got}
    assert by == {(1, 1, True), (2, 2, True), (3, 3, True), (None, None, True), (4, 4, True), (5, 4, False), (6, 4, False)}


def test_one_doc_id_with_two_texts(spark):
    rng = random.Random(6)
    one, two, three = (" ".join(rng.choices([f"{c}{i}" for i in range(300)], k=80)) for c in "xyz")
    near = " ".join(["changed", *one.split()[1:]])
    rows = [(3, near), (9, one), (9, two), (12, two), (9, three), (7, "alone " + three), (8, two + " z1 z2")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    text = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_hash", F.xxhash64("text"))
    by = {(r.doc_id, r.text): (r.class_id, r.kept) for r in got.join(text, ["doc_id", "text_hash"]).collect()}
    assert len(by) == len(rows)
    assert by[3, near] == (3, True) and by[9, one] == (3, False)
    assert by[8, two + " z1 z2"] == (8, True) and by[9, two] == by[12, two] == (8, False)
    assert by[7, "alone " + three] == (7, True) and by[9, three] == (7, False)
    rows = [(3, near), (9, one), (9, two), (12, two)]
    text = {r.text_hash: r.text for r in text.collect()}
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, text[r.text_hash]): (r.class_id, r.kept) for r in got} == {(3, near): (3, True), (9, one): (3, False), (9, two): (9, True), (12, two): (9, False)}


def test_large_group_in_small_blocks(spark, monkeypatch):
    import stemma.llm.near_dup as module

    monkeypatch.setattr(module, "BLOCK", 4)
    rows = texts(3, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    assert got == classes(rows, idf_table(df))


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_samples_agree_in_proportion_to_similarity():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    w = rng.uniform(1, 5, 400).astype(np.float32)
    a, b = slice(0, 300), slice(60, 400)
    doc = np.r_[np.zeros(300, int), np.ones(340, int)]
    order = [np.argsort(h[a]), np.argsort(h[b])]
    got = samples(doc, np.r_[h[a][order[0]], h[b][order[1]]], np.r_[w[a][order[0]], w[b][order[1]]], 2, 4000)
    true = w[60:300].sum() / w.sum()
    assert abs((got[0] == got[1]).mean() - true) < 0.03


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 40), (60, 40)], "x long, y long")
    got = {r.id: r.class_id for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(21)}, 40: 40, 50: 40, 60: 40}
