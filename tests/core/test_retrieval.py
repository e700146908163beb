import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stemma.operators import retrieval as V
from stemma.queries import QUERIES

PAIR = "doc_id int, dependent int, support int, kind string, rrf double, protected boolean, alias boolean, rerank_score double, rerank_rank int"


def test_final_selection_takes_the_reference_budgets_and_order(spark):
    logic = [(1, 99, i, "logic", 0.001 * i, False, False, None, None) for i in range(40)]
    few = [(1, 99, 50 + i, "definition", 0.1, False, False, None, None) for i in range(4)]
    many = [(1, 98, 50 + i, "definition", 0.1, False, False, None, None) for i in range(12)] + [(1, 98, i, "logic", 0.1, False, False, None, None) for i in range(40)]
    got = V.final_selection(spark.createDataFrame(logic + few + many, PAIR)).groupBy("dependent", "kind").agg(F.count("*").alias("n")).collect()
    assert {(r.dependent, r.kind): r.n for r in got} == {(99, "logic"): 26, (99, "definition"): 4, (98, "logic"): 20, (98, "definition"): 10}
    rows = [
        (1, 9, 1, "logic", 0.1, False, True, None, None), (1, 9, 2, "logic", 0.1, True, False, 0.1, 2), (1, 9, 3, "logic", 0.9, True, False, None, None),
        (1, 9, 4, "logic", 0.2, False, False, 0.5, 1), (1, 9, 5, "logic", 0.3, False, False, 0.5, 2), (1, 9, 6, "logic", 0.3, False, False, None, None), (1, 9, 7, "logic", 0.3, False, False, None, None),
    ]
    got = V.final_selection(spark.createDataFrame(rows, PAIR)).orderBy("place").collect()
    assert [r.support for r in got] == [1, 2, 3, 4, 5, 7, 6]


def test_small_budgets(spark):
    rows = [(1, 9, i, "definition" if i < 4 else "logic", 0.01 * i, False, False, None, None) for i in range(9)]
    df = spark.createDataFrame(rows, PAIR)
    assert {r.support for r in V.final_selection(df, 3, 2).collect()} == {2, 3, 6, 7, 8}
    assert {r.support for r in V.capped(df, 6, 2).collect()} == {3, 4, 5, 6, 7, 8} == {r.support for r in V.capped(df, 7, 1).collect()}


def test_neighbours_come_whole(spark, tmp_path):
    long = ["0123456789012345678901" + x * 30 for x in "abcde"]
    spark.createDataFrame([("c", i, "user", t) for i, t in enumerate(long)], "conv_id string, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: (r.before, r.after) for r in QUERIES["neighbour_context_whole"](spark, str(tmp_path)).collect()}
    assert got[2] == (long[:2], long[3:]) and got[0] == ([], long[1:3]) and got[4] == (long[2:4], [])


def test_implicit_pairs_are_chosen_before_ranking(spark):
    units = [(1, i, "P" if i >= 9 else f"q{i}", i == 0, i != 0) for i in range(12)] + [(1, 12, None, False, True), (1, 13, "", False, True)]
    u = spark.createDataFrame(units, "doc_id int, pos int, parent string, definition boolean, statement boolean")
    gone = spark.createDataFrame([(1, "P", "q8"), (1, "P", "q7")], "doc_id int, dependent_parent string, support_parent string")
    near = {}
    for r in V.implicit_window(u, gone, 3).collect():
        near.setdefault(r.dependent, {})[r.rank] = (r.support, round(1 / r.score))
    assert near[11] == {1: (6, 5), 2: (5, 6), 3: (4, 7)} and near[13] == {1: (12, 1), 2: (11, 2), 3: (10, 3)} and 1 not in near
    pairs = spark.createDataFrame([(1, 11, s) for s in (0, 1, 7, 8, 9, 10, 12)], "doc_id int, dependent int, support int")
    assert {(r.support, r.kind) for r in V.implicit_pairs(pairs, u, gone).collect()} == {(0, "definition"), (1, "logic")}


def test_evaluation_by_kind_and_definition_gate(spark):
    rows = [(1, 99, i, "definition", ["a"], True) for i in range(11)] + [(1, 99, 40, "logic", ["a", "b"], True), (1, 99, 41, "logic", ["b"], True), (1, 98, 41, "logic", ["b"], False)]
    df = spark.createDataFrame(rows, "doc_id int, dependent int, support int, kind string, channels array<string>, selected boolean")
    gold = [(1, 99, 0, "definition", False), (1, 99, 41, "logic", False), (1, 99, 40, "logic", False), (1, 99, 50, "logic", True)]
    g = spark.createDataFrame(gold, "doc_id int, dependent int, support int, kind string, explicit boolean")
    r = V.accepted(V.evaluation_by_kind(df, g)).first()
    assert (r.n_gold, r.recall, r.n_definition, r.recall_definition, r.n_logic, r.n_far, r.far_recall) == (3, 1.0, 1, 1.0, 2, 2, 1.0)
    assert (r.n_selected, r.most, r.most_definitions, r.accepted) == (13, 13, 11, False)
    assert r.channel_counts == {"a": 12, "b": 3} and r.exclusive_hits == {"a": 1, "b": 1}
    assert V.accepted(V.evaluation_by_kind(df.where("support > 0"), g.where("support > 0"))).first().accepted
    t = V.retrieval_report(df).first()
    assert (t.pre_rerank, t.logic, t.definition, t.selected, t.selected_logic, t.selected_definition, t.n_dependents) == (14, 3, 11, 13, 2, 11, 2)
    assert t.distance_buckets == {"1-5": 0, "6-30": 0, ">30": 14} and t.channel_counts == {"a": 12, "b": 3}
    assert {(r.dependent, r.pre_rerank, r.selected) for r in V.dependent_counts(df).collect()} == {(99, 13, 13), (98, 1, 0)}


def test_best_of_a_block_in_bounded_memory(monkeypatch):
    """A whole batch against a whole block of queries was one matrix, with as many indices."""
    monkeypatch.setattr(V, "WAITING", 50_000, raising=False)
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(20_000, 8)).astype(np.float32)
    vectors[rng.choice(20_000, 6000, replace=False)] = vectors[3]  # copies
    ids = rng.permutation(20_000).astype(np.int64)
    asked = rng.choice(20_000, 2048, replace=False)
    unit = vectors.astype(np.float64) / np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)

    class Block:
        value = (ids[asked], unit[asked])

    cut = lambda lo, hi: pa.RecordBatch.from_arrays([pa.array(ids[lo:hi]), pa.FixedSizeListArray.from_arrays(pa.array(vectors[lo:hi].ravel()), 8).cast(pa.list_(pa.float32()))], names=["vec_id", "embedding"])
    tracemalloc.start()
    got = pa.Table.from_batches(list(V._best_of_block(Block, 5)([cut(0, 10_000), cut(10_000, 20_000)]))).to_pandas()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100e6 and len(got) < 2048 * 40
    got["score"] = got.score.round(6)
    best = got.sort_values(["dependent", "score", "support"], ascending=[True, False, True]).groupby("dependent").head(5)
    told = {d: list(g.support) for d, g in best.groupby("dependent")}
    for a in asked[:100]:
        before = np.flatnonzero(ids < ids[a])
        want = sorted(zip(-(unit[before] @ unit[a]).round(6), ids[before]))[:5]
        assert told.get(ids[a], []) == [i for _, i in want]
