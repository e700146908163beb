import random

import pytest
from pyspark.sql import functions as F

from stemma.operators import graph as G
from stemma.operators import nodes as N
from stemma.operators import predicates as P
from stemma.operators import relational as R
from stemma.operators import tex as X

TEX = """% \\begin{theorem} not this \\end{theorem}
\\newtheorem{satz}{Theorem}[section]
\\newtheorem{hilf}[satz]{Lemma}
\\newtheorem*{bem}{Remark}
\\section{One} Some residual paragraph with enough letters here.
\\begin{satz}[Main]\\label{t:a} 100\\% A \\end{satz}
\\begin{proof} P1 \\end{proof}
\\begin{proof} P2 \\end{proof}
\\begin{hilf} B \\end{hilf}
\\begin{bem} C \\end{bem}
\\section{Two}
\\begin{satz} D \\end{satz}
"""


def test_tex_model(spark):
    df = spark.createDataFrame([(1, TEX), (2, None)], "doc_id int, text string")
    model = X.source_model(df)
    rows = model.orderBy("start").collect()
    assert all(TEX[r.start : r.end] == r.text for r in rows)
    got = [(r.env, r.type, r.number, r.label, r.title) for r in rows if r.kind == "record"]
    assert got == [("satz", "theorem", "1.1", "t:a", "Main"), ("hilf", "lemma", "1.2", None, None), ("bem", "remark", None, None, None), ("satz", "theorem", "2.1", None, None)]
    proofs = {r.number: r.proof for r in X.attached_proofs(model).collect()}
    assert "P1" in proofs["1.1"] and proofs["1.2"] is None and len(proofs) == 4
    rest = [r.text for r in X.residual(model, df).collect()]
    assert len(rest) == 2 and any("residual paragraph" in t for t in rest)
    assert len(X.masked(TEX)) == len(TEX) and "not this" not in X.masked(TEX) and "100\\%" in X.masked(TEX)
    assert X.macros("\\newcommand{\\R}{\\mathbb{R}} \\def\\x{\\input{y}} \\newcommand\\R[1]{Q#1}") == {"\\R": "Q#1"}


def test_predicates(spark):
    row = spark.range(1).select(P.snake_key(F.lit("isPrimeIn x")).alias("s"), P.predicate_id(F.lit("_TMP_IsOpen_DUP_2")).alias("p"), P.name_key(F.lit("Is-open")).alias("n")).first()
    assert (row.s, row.p, row.n) == ("IS_PRIME_IN_X", "P_IS_OPEN", "ISOPEN")
    e = [(0, "IsOpen", "IsOpen", 1, ["Set"], "{set} is open", "open set"), (1, "is_open", "Open", 1, ["Entity"], "{set} is open", "open"), (2, "Q", "IsOpen", 1, ["Group"], "x", "y"), (3, "IsOpen", "IsOpen", 2, ["Set", "Set"], "z", "w")]
    df = spark.createDataFrame(e, "pos int, predicate string, name string, arity int, sorts array<string>, template string, gloss string")
    assert {(r.x, r.y) for r in P.candidate_pairs(df).collect()} == {(0, 1)}
    pairs = P.candidate_pairs(df, {"Group": ["Set"]})
    assert {(r.x, r.y) for r in pairs.collect()} == {(0, 1), (0, 2)}
    assert [tuple(r.members) for r in P.candidate_groups(pairs).collect()] == [(0, 1, 2)]
    groups = spark.createDataFrame([(1, [0, 1, 2])], "group int, members array<int>")
    told = spark.createDataFrame([(1, 1, [0, 1, 9]), (1, 2, [1, 2])], "group int, cluster int, members array<int>")
    assert {(r.member, r.cluster) for r in P.decided_clusters(told, groups).collect()} == {(0, 1), (1, 1), (2, None)}
    uses = spark.createDataFrame([("a", 0, "x", "Open", "t"), ("a", 1, "x", "Closed", "t"), ("b", 2, "x", "Open", "u")], "cluster string, pos int, predicate string, name string, template string")
    assert {(r.cluster, r.name, r.key) for r in P.registry(uses).collect()} == {("a", "Open", "P_OPEN"), ("b", "Open", "P_OPEN_ALT_001")}


def test_nodes(spark):
    df = spark.createDataFrame([(1, 0, "theorem", "S  x", "c"), (1, 1, "definition", None, "S x"), (1, 2, "theorem", "S x", "d")], "doc_id int, pos int, node_type string, source_original_form string, content string")
    sealed = N.sealed(df)
    assert sealed.select("global_id").distinct().count() == 1
    with pytest.raises(Exception, match="one id, two sources"):
        N.deduplicated(sealed).collect()
    assert N.deduplicated(sealed.where("pos > 0")).first().copies == 2
    one = sealed.where("pos = 0")
    derived = one.select("global_id", "source_sha256", F.lit("T").alias("title"), F.lit("bad").alias("content"))
    got = N.merged_under_seal(one, derived, ["title"]).first()
    assert (got.title, got.content, got.ignored) == ("T", "c", ["content"])
    with pytest.raises(Exception, match="source changed"):
        N.merged_under_seal(one, derived.withColumn("source_sha256", F.lit("x")), ["title"]).collect()
    iff = spark.range(1).select(N.iff_directions(F.lit("A iff B iff C")).alias("a"), N.iff_directions(F.lit("diff")).alias("b")).first()
    assert [(r.source, r.target) for r in iff.a] == [("A", "B"), ("B", "C"), ("C", "A")] and iff.b == []
    units = spark.createDataFrame([(1, 0, "g", "c", False, [(1, "s1", None), (2, "s2", None)]), (1, 1, "h", "d", None, None), (1, 2, "i", "e", True, None)], "doc_id int, pos int, global_id string, content string, degraded boolean, sub_nodes array<struct<index:int,content:string,conclusion:string>>")
    assert {(r.unit, r.text) for r in N.match_units(units).collect()} == {("g__sub1", "s1"), ("g__sub2", "s2"), ("h", "d")}


def test_verdicts_and_decisions(spark):
    v = spark.createDataFrame([(1, "accepted", "direct", ["e"], False, False), (2, "accepted", "indirect", ["e"], False, False), (3, "review", "indirect", [], False, False), (4, "odd", None, None, None, None), (5, "accepted", "explicit", ["e"], True, False)], "key int, verdict string, level string, evidence array<string>, missing_premise boolean, excluded boolean")
    assert {r.key: (r.verdict, r.guard_reason) for r in N.judged_verdicts(v).collect()} == {1: ("accepted", None), 2: ("rejected", "level_too_weak"), 3: ("rejected", "no_evidence"), 4: ("rejected", "unknown_verdict"), 5: ("rejected", "missing_premise")}
    nodes = spark.createDataFrame([(1, "x = 1"), (2, "words"), (3, "w"), (4, "w")], "key int, text string")
    told = spark.createDataFrame([(1, "quarantine"), (2, "quarantine"), (3, "zzz")], "key int, action string")
    assert {r.key: r.action for r in N.cleaning_decisions(nodes, told).collect()} == {1: "manual_review", 2: "quarantine", 3: "manual_review", 4: "manual_review"}


def test_graph_cycles_and_merge(spark):
    nodes = spark.range(6)
    edges = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (3, 4), (4, 3), (4, 5), (2, 2)], "src long, dst long")
    got = {r.id: (r.depth, r.cyclic) for r in G.longest_depths(nodes, edges).collect()}
    assert got == {0: (0, False), 1: (1, False), 2: (2, False), 3: (3, True), 4: (3, True), 5: (3, True)}
    e = spark.createDataFrame([(1, 2, "logic", "a", 0), (1, 2, "logic", "a b", 1), (1, 2, "logic", "b", 2), (1, 2, "logic", None, 3)], "src int, dst int, relation string, reason string, pos int")
    assert G.merge_edges(e).first().reason == "a; a b"
    L, D = G.LOGIC, G.DEFINITION
    rows = [
        ("a", "b", L, "short", 0), ("b ", "a", L, "a longer reason", 1),  # the longer reason wins
        ("c", "c", L, "x", 2), ("c", "d", "odd", "x", 3), ("c", "", L, "x", 4), (None, "d", L, "x", 5),  # none of them counts
        ("e", "f", L, "one", 6), ("e", "f", D, "", 7), ("e", "f", D, None, 8),  # a definition before logic, the first of two
        ("g", "h", L, "it  does NOT depend on g", 9), ("h", "g", L, "", 10),  # a denial is no edge
        ("i", "j", L, "same", 11), ("j", "i", L, "size", 12),  # j stands later
        ("k", "l", L, "x", 13), ("l", "k", D, "正", 14), ("k", "l", L, "正则匹配：y", 15),  # by reference
        ("u", "v", L, "x", 16), ("v", "u", L, "y", 17),  # neither is in the order: the pair that comes first
        ("i", "w", L, "x", 18), ("w", "i", L, "y", 19),  # w is unknown, so i stands later
    ]
    f = spark.createDataFrame(rows, "src string, dst string, relation string, reason string, pos int")
    order = spark.createDataFrame([("i", 1), ("j", 2), ("a", 0), ("b", 3)], "id string, pos int")
    assert sorted((r.src, r.dst, r.pos) for r in G.filter_edges(f, order).collect()) == [("b", "a", 1), ("e", "f", 7), ("h", "g", 10), ("i", "w", 18), ("j", "i", 12), ("k", "l", 15), ("u", "v", 16)]
    checked = R.checked_edges(spark.createDataFrame([(0, 0), (0, 9), (9, 0), (0, 1)], "src long, dst long"), nodes)
    assert {(r.src, r.dst): r.problem for r in checked.collect()} == {(0, 0): "self_loop", (0, 9): "missing_target", (9, 0): "missing_source", (0, 1): None}
    t = spark.createDataFrame([(1, "a")], "id int, name string")
    assert {tuple(r) for r in G.merge_nodes(t, spark.createDataFrame([(1, "a"), (1, "b"), (1, "b")], t.schema)).collect()} == {(1, "a"), (1, "b")}


def test_candidate_pairs_by_prefix_lose_none(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(12)]
    words = lambda n: " ".join(rng.choices(vocab, k=rng.randrange(n)))
    rows = [(i, rng.choice(["IsA", "Divides", f"N{i}"]), f"n{i % 17}", 1, ["Set"], words(5), words(6)) for i in range(60)]
    df = spark.createDataFrame(rows, "pos int, predicate string, name string, arity int, sorts array<string>, template string, gloss string")

    def alike(a, b):
        a, b = set(a.split()), set(b.split())
        return bool(a and b) and len(a & b) / len(a | b) >= 0.5

    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (a[1] == b[1] or a[2] == b[2] or alike(a[5], b[5]) or alike(a[6], b[6]))}
    assert {(r.x, r.y) for r in P.candidate_pairs(df).collect()} == want


def sequential(ids, links):
    """Leaders one after the other, as they come."""
    near = {}
    for x, y in links:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    free, out = set(ids), {}
    for i in sorted(ids):
        if i in free:
            out[i] = i
            for j in near.get(i, ()):
                if j in free and j > i:
                    out[j] = i
                    free.discard(j)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_leaders_as_in_order(spark, seed):
    rng = random.Random(seed)
    ids = rng.sample(range(200), 80)
    links = [tuple(rng.sample(ids, 2)) for _ in range(90)] + [(ids[0], ids[0]), (ids[0], 9999)]
    got = G.leaders(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(links, "x long, y long"))
    assert {r.id: r.leader for r in got.collect()} == sequential(ids, [p for p in links if 9999 not in p])


def test_leaders_along_a_chain(spark):
    """0-1-2-...-9: every second node leads, each decided only after the one before."""
    ids = list(range(10))
    links = [(i, i + 1) for i in ids[:-1]]
    got = G.leaders(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(links, "x long, y long"))
    assert {r.id: r.leader for r in got.collect()} == {i: i - i % 2 for i in ids} == sequential(ids, links)
    assert G.leaders(spark.createDataFrame([], "id long"), spark.createDataFrame([], "x long, y long")).count() == 0


def test_longest_depths_of_chains_trees_and_ladders(spark):
    """A chain took a round of writes for each link."""
    rng = random.Random(7)
    chain = [(i, i + 1) for i in range(100)]
    net = [(1000 + a, 1000 + b) for a, b in (sorted(rng.sample(range(60), 2)) for _ in range(110))]
    ladder = [(2000 + 2 * i + a, 2002 + 2 * i + b) for i in range(4) for a in (0, 1) for b in (0, 1)]
    loops = [(3000, 3001), (3001, 3002), (3002, 3001), (3002, 3003), (3010, 3011), (3011, 3010), (3011, 3012), (3013, 3012), (3013, 3014), (3012, 3014), (3014, 3015)]
    for edges, most in ((chain, 250), (net + ladder + loops, 2000)):
        ids = sorted({x for e in edges for x in e} | {9999})
        ahead = {i: {a for a, b in edges if b == i and a != b} for i in ids}
        depth: dict[int, int] = {}
        while ready := [i for i in ids if i not in depth and ahead[i] <= depth.keys()]:
            depth |= {i: max([depth[a] + 1 for a in ahead[i]], default=0) for i in ready}
        want = {i: (depth.get(i, max(depth.values()) + 1), i not in depth) for i in ids}
        group = f"depths {most}"
        spark.sparkContext.setJobGroup(group, group)
        got = G.longest_depths(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, "src long, dst long"))
        assert {r.id: (r.depth, r.cyclic) for r in got.collect()} == want
        spark.sparkContext.setJobGroup("others", "others")
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < most
