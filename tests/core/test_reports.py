import pytest
from pyspark.sql import functions as F

from stemma.functions import references as X
from stemma.operators import predicates as P
from stemma.operators import relational as R
from stemma.operators import retrieval as V


def test_models(spark):
    calls = spark.createDataFrame([("a", True, 1.0), ("a", True, 3.0), ("a", False, 9.0), ("b", False, 1.0)], "model string, ok boolean, seconds double")
    got = {r.model: (r.n, round(r.success, 3), r.median, r.longest) for r in R.probe_summary(calls).collect()}
    assert got == {"a": (3, 0.667, 3.0, 3.0), "b": (1, 0.0, None, None)}
    models = spark.createDataFrame([("x", 10.0, 0.5), ("y", 5.0, 1.0)], "model string, rps double, success double")
    assert [(r.model, round(r.score, 2)) for r in R.model_scores(models).collect()] == [("x", 0.8), ("y", 0.7)]


def test_groupings(spark):
    a, b = (spark.createDataFrame(r, "k int, v string") for r in ([(1, "x"), (1, "w")], [(2, "y")]))
    assert {(r.k, tuple(r.left_values), tuple(r.right_values)) for r in R.grouped_sides(a, b, "k", "v").collect()} == {(1, ("w", "x"), ()), (2, (), ("y",))}
    rows = spark.createDataFrame([(0, ["n", "m"], "e"), (1, ["n"], "f")], "pos int, names array<string>, explanation string")
    assert {r.name: [u.pos for u in r.uses] for r in R.inverted(rows).collect()} == {"n": [0, 1], "m": [0]}
    same = spark.createDataFrame([("y", "x")], "name string, canonical string")
    assert {tuple(r) for r in R.canonical(spark.createDataFrame([(1, "y"), (1, "x")], "k int, v string"), same, "v").select("k", "v").collect()} == {(1, "x")}
    titles = spark.createDataFrame([("T", "a $x^2$"), ("T", "b"), ("U", "$y$")], "title string, content string")
    assert sorted(r.title for r in R.unique_titles(titles).collect()) == ["T", "T ($x^2$)", "U"]


def test_rerank(spark):
    c = spark.createDataFrame([(1, 9, s, "logic", f"c{s}", 1.0 / (s + 1)) for s in range(5)], "doc_id int, dependent int, support int, kind string, candidate_id string, rrf double")
    assert [list(r.ids) for r in V.rerank_tasks(c, 2).orderBy("batch").collect()] == [["c0", "c1"], ["c2", "c3"], ["c4"]]
    scores = spark.createDataFrame([(f"c{s}", s) for s in range(5)], "candidate_id string, rerank_score int")
    assert {r.support: r.rerank_rank for r in V.reranked(c, scores).collect()} == {4: 1, 3: 2, 2: 3, 1: 4, 0: 5}
    with pytest.raises(Exception, match="no score"):
        V.reranked(c, scores.limit(4)).collect()
    capped = V.capped(c.withColumns({"alias": F.lit(False), "protected": F.lit(False), "parent": F.lit("p")}), 2, 1, "parent")
    assert {r.support for r in capped.collect()} == {0, 1}


def test_aliases_and_registry(spark):
    got = spark.range(1).select(X.aliases(F.lit("定理 2.1"), F.lit("Main"), F.array(F.lit("Weyl"))).alias("a"), X.aliases(F.lit(None).cast("string"), F.lit("abc"), F.lit(None).cast("array<string>")).alias("b")).first()
    assert {"定理2.1", "定理 2.1", "Theorem 2.1", "Theorem2.1", "Weyl Theorem 2.1", "定理2.1Weyl", "Main"} <= set(got.a) and got.b == []
    rows = spark.createDataFrame([("K", 1, ["S"], ["a"], ["t"]), ("K", 1, ["S"], ["b"], ["t"]), ("K", 2, ["S", "S"], ["a"], ["t"])], "key string, arity int, sorts array<string>, names array<string>, templates array<string>")
    assert {(r.arity, tuple(r.names), r.merged) for r in P.merged_registry(rows).collect()} == {(1, ("a", "b"), 2), (2, ("a",), 1)}
