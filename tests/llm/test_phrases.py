import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from stemma.llm import phrases as P

SCHEMA = "doc_id long, lang string, text string, source string, Lang_2 string"
NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, least, most):
    """Every phrase counted and every longer one looked through."""
    out = []
    for lang in {r[1] if r[1] is not None else "und" for r in rows}:
        f, n = Counter(), 0
        for r in rows:
            if (r[1] if r[1] is not None else "und") == lang:
                for w in pieces(r[2]):
                    n += len(w)
                    for m in range(1, 5):
                        for j in range(len(w) - m + 1):
                            f[tuple(w[j : j + m])] += 1
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[j : j + len(p)] == p for j in range(len(q) - len(p) + 1))
        best = []
        for p, a in some.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and inside(p, q) for q, b in some.items()):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:most])]
    return sorted(out)


def some_rows(seed, n=60):
    r = random.Random(seed)
    vocabulary = ["a", "b", "of", "The", "new", "York", "zürich", "x\x0bq", "é e", "0"]
    rows = []
    for i in range(n):
        words = []
        while len(words) < r.choice([0, 3, 30, 80]):
            words += r.choice([["New", "York", "city"], ["a", "a", "a"], ["in", "the", "long", "run"], r.sample(vocabulary, 2)])
            words[-1] += r.choice(["", "", "", ".", ",\n", "\t", "!?"])
        rows.append((i, r.choice(["en", "en", "de", None, "und"]), " ".join(words), "s", "x"))
    return rows + [(900, "en", None, None, None), (901, None, "", "s", None), (None, "en", " \t. ;", "s", "y"), rows[0], rows[0]]


def got(df):
    return sorted(tuple(r[n] for n in NAMES) for r in df.collect())


@pytest.mark.parametrize("least,most,shard", [(4, 2000, 1 << 23), (2, 7, 300)])
def test_against_brute_force(spark, monkeypatch, least, most, shard):
    monkeypatch.setattr(P, "SHARD_BYTES", shard)
    rows = some_rows(least)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(P.collocations(df, least, most)) == brute(rows, least, most)


def test_sql_says_the_same(spark, tmp_path):
    rows = some_rows(3, 300)
    spark.createDataFrame([r[:3] for r in rows], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(P.OP12_SQL)
    assert [d[0] for d in want.description] == NAMES
    found = sorted(want.fetchall())
    assert found == brute(rows, 30, 2000) and len(found) >= 10
    assert got(P.op12_phrases(spark, str(tmp_path))) == found


def test_automaton():
    """Counts are of end positions, and the suffix link of a state is the state of the phrase without its first word."""
    r = random.Random(1)
    runs = [[r.randrange(4) for _ in range(r.randrange(1, 40))] for _ in range(20)]
    words = np.array([w for run in runs for w in run])
    joined = np.array([i > 0 for run in runs for i in range(len(run))])
    a = P.Automaton(words, joined, 4)
    want = Counter(tuple(run[j : j + m]) for run in runs for m in range(1, 5) for j in range(len(run) - m + 1))

    def spelled(s):
        return (*spelled(a.prefix[s]), int(a.word[s])) if s >= 0 else ()

    found = {spelled(s): (int(a.count[s]), s) for s in range(len(a.size))}
    assert {p: n for p, (n, _) in found.items()} == want
    for p, (_, s) in found.items():
        assert a.size[s] == len(p) and spelled(a.link[s]) == p[1:]
    spelled_out = [x for text in a.phrases(pa.array([b"0", b"1", b"2", b"3"], pa.large_binary())) for x in text.to_pylist()]
    named = {tuple(map(int, x.split())): n for x, n in zip(spelled_out, a.count.tolist(), strict=True)}
    assert named == want


def test_counts_beyond_64_bits(spark):
    big = 6 * 10**17
    counts = spark.createDataFrame([("en", "a", big), ("en", "b", big + 1), ("en", "a b", big - 5)], "lang string, phrase string, n long")
    r = P.scored(counts).first()
    assert (r.phrase, r.a, r.l, r.r, r.score) == ("a b", big - 5, big, big + 1, 2000000 * (big - 5) // (2 * big + 1))


def test_empty_and_very_long(spark):
    assert P.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "en", "left right " * 200_000, "s", ""), (2, "en", "x" * 2_000_000, "s", "")]
    assert got(P.collocations(spark.createDataFrame(rows, SCHEMA))) == brute(rows, 30, 2000)


def test_many_languages(spark):
    rows = [(i, f"l{i % 300}", "one two three. " * 20, "s", "") for i in range(600)]
    assert got(P.collocations(spark.createDataFrame(rows, SCHEMA))) == brute(rows, 30, 2000)
