import random
import re
from collections import Counter

import numpy as np

from stemma.llm.quality_rules import CORE, X, chi_square_limit, core_estimates, judged, measured

SPACES = "[\x20\x09-\x0d]+"


def brute(text):
    text = text or ""
    ws = [w for w in re.split(SPACES, text) if w]
    tri = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n, covered = Counter(tri), set()
    for i, t in enumerate(tri):
        if n[t] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.sub(SPACES, "", x)]
    bad = len(ws) < 50 or 100 * len(covered) > 50 * len(ws)
    return len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), bad


def cases():
    rng = random.Random(4)
    vocab = ["a", "bé", "#x", "漢字", "d|", "e", "f&g", "nbsp\xa0in"]
    return [None, "", " ", "\n\n", "a", "a b a b a", "a b c", "a a a a", "x\x0by\x0cz\rw"] + ["".join(rng.choice(vocab) + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(rng.randrange(200))) for _ in range(60)] + ["word " * 5000]


def test_base_counts(spark):
    rows = [(i, t, "x") for i, t in enumerate(cases())]
    got = measured(spark.createDataFrame(rows, "doc_id long, text string, TEXT2 string")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert {r[0]: tuple(r[1:]) for r in got} == {i: brute(t) for i, t, _ in rows}


def prose(rng, n=120):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(3, 8))) for _ in range(n))


def test_outliers_go_and_clean_stay(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(60, 400)), "en", "s") for i in range(300)]
    rows += [(1000 + i, " ".join(w + "%%%" for w in prose(rng).split()), "en", "s") for i in range(20)]
    rows += [(2000, prose(rng), None, None), (2001, None, "en", "s"), (2001, None, "en", "s")]
    got = {r.doc_id: r for r in judged(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, Doc_Id int")).collect()}
    assert all(got[i].kept for i in range(300)) and got[2000].kept
    assert not any(got[1000 + i].kept or got[1000 + i].base_failed for i in range(20))
    assert got[2001].base_failed and not got[2001].kept


def test_repeated_lines_alone_reject(spark):
    rng = random.Random(9)
    lines = lambda n: [prose(rng, 12) for _ in range(n)]
    rows = [(i, "\n".join(lines(rng.randrange(8, 30))), "en", "s") for i in range(300)]
    few = lines(4)
    rows += [(1000 + i, "\n".join(rng.sample(few, 4) + rng.choices(few, k=12) + lines(1)), "en", "s") for i in range(5)]
    got = {r.doc_id: r for r in judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i in range(300))
    assert not any(got[1000 + i].kept for i in range(5))


def exact_core(v):
    """The least-determinant mean and covariance of a share CORE of the rows over many random starts, floors applied."""
    rng, h, best = np.random.default_rng(0), int(np.ceil(CORE * len(v))), (np.inf, None, None)
    floors = np.array(list(X.values())) ** 2

    def fit(rows):
        c = np.cov(rows.T, bias=True)
        c[np.diag_indices(len(c))] = np.maximum(np.diag(c), floors)
        return rows.mean(0), c

    for _ in range(60):
        m, c = fit(v[rng.choice(len(v), 12, replace=False)])
        last = np.inf
        while True:
            d = np.einsum("ij,jk,ik->i", v - m, np.linalg.inv(c), v - m)
            m, c = fit(v[np.argsort(d)[:h]])
            det = np.linalg.det(c)
            if det >= last * (1 - 1e-9):
                break
            last = det
        best = min(best, (last, m, c), key=lambda x: x[0])
    d = np.einsum("ij,jk,ik->i", v - best[1], np.linalg.inv(best[2]), v - best[1])
    return best[0], d / max(1, np.median(d) / chi_square_limit(0.5, len(X)))


def test_core_against_brute_force(spark):
    rng = np.random.default_rng(3)
    mix = rng.normal(size=(5, 5)) + 2 * np.eye(5)
    groups = {"a": np.r_[rng.normal(size=(400, 5)) @ mix, rng.normal(size=(80, 5)) * 0.3 + 9], "b": np.r_[rng.normal(size=(300, 5)) * 2 - 4, np.full((40, 5), 8.0)]}
    rows = [(i, g, *map(float, x)) for g, v in groups.items() for i, x in enumerate(v)]
    each = spark.createDataFrame(rows, "doc_id long, group string, " + ", ".join(f"{a} double" for a in X))
    got = {r.group: r for r in core_estimates(each, 2).collect()}
    names = list(X)
    for g, v in groups.items():
        lower = np.array([[got[g][f"l_{a}_{b}"] if j <= i else 0 for j, b in enumerate(names)] for i, a in enumerate(names)])
        y = np.linalg.solve(lower, (v - np.array([got[g][f"m_{a}"] for a in names])).T)
        mine, (det, exact) = (y**2).sum(0) / got[g].scale, exact_core(v)
        assert np.prod(np.diag(lower)) ** 2 <= det * 1.25
        limit = chi_square_limit(1e-6, 5)
        assert ((mine > limit) == (exact > limit)).all() and np.abs(np.log(mine / exact)).max() < 0.35


def test_empty_table_and_limit(spark):
    assert judged(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0
    assert abs(chi_square_limit(0.05, 5) - 11.0705) < 1e-3 and abs(chi_square_limit(0.5, 2) - 1.38629) < 1e-4


def test_main_path_has_no_python(spark):
    df = spark.createDataFrame([(1, "a b", "en", "s")], "doc_id long, text string, lang string, source string")
    plan = judged(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)
