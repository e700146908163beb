import random

from stemma.operators.search import tree_search

TREE = "id long, parent long, name string, level long, type string, path string"


def test_tree_search_equals_a_walk(spark):
    r = random.Random(4)
    tree = [(0, None, "root", 0, "dir")]
    for i in range(1, 40):
        up = r.choice([t for t in tree if t[3] < 4])
        tree.append((i, up[0], r.choice("abc"), up[3] + 1, r.choice(["lean", "dir", None])))
    answers = [(s, n, r.choice("abcd")) for s in range(6) for n in range(40) for _ in range(r.choice([0, 1, 2, 3]))]
    inner, by_id = {t[1] for t in tree}, {t[0]: t for t in tree}

    def walk(s, node, path):
        _, _, _, level, kind = by_id[node]
        said = [a[2] for a in answers if a[:2] == (s, node)] if node in inner else []
        if not said:
            return [(s, node, level, path, "active" if kind == "lean" else "dead")]
        below = [(name, min((t[0] for t in tree if t[2:4] == (name, level + 1)), default=None)) for name in said]
        ends = [e for name, at in below if at is not None for e in walk(s, at, f"{path}/{name}" if path else name)]
        return ends or [(s, node, level, path, None)]

    want = [e for s in range(6) for e in walk(s, 0, "")]
    assert {e[4] for e in want} == {"active", "dead", None} and len(want) != len(set(want))
    nodes, said = spark.createDataFrame([(*t, "extra") for t in tree], TREE), spark.createDataFrame([*answers, (1, 0, None)], "statement long, node long, name string")
    statements = spark.createDataFrame([(s,) for s in range(6)], "statement long")
    got = [tuple(x) for x in tree_search(nodes, statements, said).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert tree_search(nodes.limit(0), statements, said).count() == 0 == tree_search(nodes, statements.limit(0), said).count()
    assert [x.state for x in tree_search(nodes, statements, said.limit(0)).collect()] == ["dead"] * 6
