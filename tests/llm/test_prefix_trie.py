import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from stemma.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, TEXT string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, rebuild=True):
    """The trie, node by node, from whole prefixes."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        made[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = []
    for p, who in members.items():
        leaves = saved = 0
        stack = [p]
        while stack:
            q = stack.pop()
            leaves += not children[q]
            saved += (len(members[q]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) if q else 0)
            stack += children[q]
        ends = ",".join(map(str, sorted(c for c in who if len(made[c]) == len(p))))
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=str)


def some_rows(seed, n_convs, longest=6):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-30, 4 * n_convs), n_convs):
        for t in range(r.choice([1, 1, 2, 3, longest])):
            turn = r.choice([t, t, t, t, None, 0])
            rows.append((c, turn, r.choice(["user", "bot", None]), r.choice(["a", "a b", "", None, "c  d\te"]), "x"))
    return rows


@pytest.mark.parametrize("seed,part", [(1, 1000), (2, 2)])
def test_against_brute_force(spark, monkeypatch, seed, part):
    monkeypatch.setattr(P, "PART", part)
    monkeypatch.setattr(P, "IDS", 16)
    rows = [*some_rows(seed, 60), (None, 1, "user", "no conversation", ""), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(P.prefix_trie(*P.rebuilt(P.numbered(df)))) == brute(rows)


def test_sql_says_the_same(spark, tmp_path):
    rows = some_rows(5, 80)
    spark.createDataFrame([r[:4] for r in rows], SCHEMA.rsplit(",", 1)[0]).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    want = con.execute(P.OP11_SQL)
    at = [[d[0] for d in want.description].index(n) for n in NAMES]
    assert sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str) == brute(rows)
    assert got(P.op11_prefix_trie(spark, str(tmp_path))) == brute(rows)


def test_long_conversations_and_copies(spark, monkeypatch):
    """A conversation much longer than a part, many copies of one, heavy and light branches at every depth."""
    monkeypatch.setattr(P, "PART", 7)
    rows = [(1, t, "user", f"w{t % 3} x", "") for t in range(40)]
    rows += [(2, t, "user", f"w{t % 3} x" if t < 25 else "other", "") for t in range(33)]
    rows += [(c, t, "bot", f"same {t}", "") for c in range(100, 160) for t in range(3)]
    rows += [(c, t, "user", f"w{t % 3} x" if t < c - 200 else f"end {c}", "") for c in range(200, 220) for t in range(c - 200 + 1)]
    turns = P.numbered(spark.createDataFrame(rows, SCHEMA))
    convs = turns.where("pos = 0").select("conv_id", "length")
    assert got(P.prefix_trie(turns, convs)) == brute(rows, rebuild=False)


def test_turnless_and_empty(spark):
    # conversation 3 has h = 3 shared turns of 0, which is absent, and no turn of its own after them
    few = [(3, 0, "user", "a", "")]
    assert zlib.crc32(b"3") % 4 >= 1
    assert got(P.prefix_trie(*P.rebuilt(P.numbered(spark.createDataFrame(few, SCHEMA))))) == brute(few)
    assert P.prefix_trie(*P.rebuilt(P.numbered(spark.createDataFrame([], SCHEMA)))).count() == 0


def test_very_long_text(spark):
    rows = [(20, 0, "user", "long " * 300_000, ""), (21, 0, "user", "long " * 300_000, ""), (22, 0, "user", "b", "")]
    assert got(P.prefix_trie(*P.rebuilt(P.numbered(spark.createDataFrame(rows, SCHEMA))))) == brute(rows)
