import pytest
from pyspark.sql import functions as F

from stemma.plans import stages as P
from stemma.sources import readers as R
from stemma.streaming import jobs as J


def test_plan_runs_once_and_resumes(spark, tmp_path):
    one = P.Stage("one", lambda s: {"b": s["a"].withColumn("x", F.col("id") + 1)}, ("a",), ("b",), ("b",))
    two = P.Stage("two", lambda s: {"c": s["b"].where("x > 1")}, ("b",), ("c",))
    plan = P.Plan([one, two], f"{tmp_path}/run")
    assert plan.execute(spark, {"a": spark.range(3)})["c"].count() == 2 and plan.done == ["one", "two"]
    assert plan.execute(spark, {"a": spark.range(3)})["c"].count() == 2 and plan.done == []
    other = P.Plan([one, P.Stage("two", two.run, ("b",), ("c",), ("c",))], f"{tmp_path}/run")
    other.execute(spark, {"a": spark.range(3)})
    assert other.done == ["two"]
    # another input, and a stored output that isn't what was written, count as not done
    assert other.execute(spark, {"a": spark.range(4)})["c"].count() == 3 and other.done == ["one", "two"]
    spark.range(9).withColumn("x", F.col("id")).write.mode("overwrite").parquet(f"{tmp_path}/run/01-two/c")
    assert other.execute(spark, {"a": spark.range(4)})["c"].count() == 3 and other.done == ["two"]
    with pytest.raises(P.ContractError):
        plan.execute(spark, {})
    with pytest.raises(P.ContractError):
        P.Plan([P.Stage("none", lambda s: {"b": s["a"].limit(0)}, ("a",), ("b",), ("b",))], f"{tmp_path}/r2").execute(spark, {"a": spark.range(1)})


def test_tasks_retry_and_recovery(spark):
    tasks = spark.createDataFrame([(i, f"t{i}") for i in range(40)], "key int, task string")
    got = {r.key: (r.ok, r.attempts) for r in P.run_tasks(tasks, lambda t: None if t == "t3" else t.upper(), lambda a: a != "T5").collect()}
    assert got[3] == (False, 3) and got[5] == (False, 3) and got[0] == (True, 1)
    answers = spark.createDataFrame([(f"t{i}", "a") for i in range(39)], "task string, answer string")
    found, left = P.recovered(tasks, lambda t: P.from_table(t, answers))
    assert found.where("ok").count() == 39 and [r.key for r in left.collect()] == [39]
    with pytest.raises(RuntimeError):
        P.recovered(tasks, lambda t: P.from_table(t, answers.limit(1)))


def test_answers_and_changes(spark):
    tasks = spark.createDataFrame([(1, [1, 2]), (2, [1, 2]), (3, [1])], "key int, ids array<int>")
    answers = spark.createDataFrame([(1, [2, 1], [0, 3]), (2, [2, 1], [0, 4])], "key int, ids array<int>, scores array<int>")
    assert {r.key: r.ok for r in P.validated_answers(tasks, answers).collect()} == {1: True, 2: False, 3: False}
    assert P.changed_tables({"a": spark.range(3), "b": spark.range(3)}, {"a": spark.range(2, -1, -1), "b": spark.range(4), "c": spark.range(1)}) == ["b", "c"]


def test_job_events():
    step = J.apply_events(None, [(1, 2, "running"), (1, 1, "start")])
    assert step == (1, 2, "running", False)
    step = J.apply_events(step, [(1, 3, "error"), (1, 4, "done"), (0, 9, "stale")])
    assert step == (1, 3, "error", True)
    assert J.apply_events(step, [(2, 1, "start")]) == (2, 1, "start", False)


def test_job_stream(spark, tmp_path):
    rows = [("a", 1, 1, "start"), ("a", 1, 2, "done"), ("a", 1, 3, "late"), ("b", 2, 1, "start"), ("b", 1, 9, "stale")]
    spark.createDataFrame(rows, "job string, token long, seq long, status string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("job string, token long, seq long, status string").parquet(f"{tmp_path}/in")
    q = J.job_states(stream, None).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
        assert {(r.job, r.status) for r in spark.sql("select * from states").collect()} == {("a", "done"), ("b", "start")}
    finally:
        q.stop()
    up = stream.writeStream.foreachBatch(J.upsert_batches(f"{tmp_path}/table", ["job"])).option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start()
    try:
        assert up.awaitTermination(120)
        assert {(r.job, r.seq) for r in spark.read.parquet(f"{tmp_path}/table/v0").collect()} == {("a", 3), ("b", 9)}
    finally:
        up.stop()


def test_rates(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:05", "x", 1.0), ("2024-01-01 00:00:55", "x", 2.0)], "t string, k string, v double").withColumn("t", F.to_timestamp("t"))
    got = J.rates(df, "t", "k", "v")
    assert got.where("n = 2").count() == 1 and got.agg(F.max("total")).first()[0] == 3.0


def test_documents_and_nodes(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.md").write_text("# x\né")
    (tmp_path / "d/b.tex").write_text("\\x")
    (tmp_path / "d/c.txt").write_text("no")
    got = {r.doc_id[-4:]: (r.format, r.text) for r in R.documents(spark, f"{tmp_path}/d").collect()}
    assert got == {"a.md": ("markdown", "# x\né"), ".tex"[-4:]: ("tex", "\\x")}
    with pytest.raises(ValueError):
        R.documents(spark, f"{tmp_path}/d", "pdf")
    (tmp_path / "n").mkdir()
    (tmp_path / "n/o.json").write_text('{"k": {"a": 1}}')
    (tmp_path / "n/l.json").write_text('[{"a": 2}, 3]')
    assert {(r.key, r.json) for r in R.nodes(spark, f"{tmp_path}/n").collect()} == {("k", '{"a":1}'), ("0", '{"a":2}'), ("1", "3")}


def test_csv_contract(spark, tmp_path):
    p = tmp_path / "u.csv"
    p.write_text('﻿name,email\n"A, B",a@x\n\nC,\nD,a@x\nE,e@x,1\n')
    got = [tuple(r) for r in R.strict_csv(spark, str(p), ["email", "name"], "email").orderBy("line").collect()]
    assert got == [(2, "a@x", "A, B", None), (4, None, "C", "missing_key"), (5, "a@x", "D", "duplicate"), (6, "e@x", "E", "wrong_fields")]
    with pytest.raises(ValueError):
        R.strict_csv(spark, str(p), ["email"], "email")


def test_graph_and_versions(spark, tmp_path):
    nodes, edges = spark.range(3), spark.createDataFrame([(0, 1), (1, 9)], "src long, dst long")
    R.save_graph(nodes, edges, f"{tmp_path}/g")
    assert [tuple(r) for r in R.load_graph(spark, f"{tmp_path}/g")[1].collect()] == [(0, 1)]
    v = tmp_path / "v/1"
    v.mkdir(parents=True)
    (v / "a.bin").write_bytes(b"1")
    (v / "manifest.json").write_text("{}")
    m = R.version_manifest(spark, str(v))
    assert R.version_problems(m, m).count() == 0 and [r.version for r in R.committed_versions(spark, f"{tmp_path}/v").collect()] == ["1"]
    saved = spark.createDataFrame(m.collect(), m.schema)
    (v / "a.bin").write_bytes(b"2")
    (v / "b.bin").write_bytes(b"2")
    assert {tuple(r) for r in R.version_problems(saved, R.version_manifest(spark, str(v))).collect()} == {("a.bin", "digest"), ("b.bin", "extra")}


def test_late_rows_replace_nothing_newer(spark, tmp_path):
    write = J.upsert_batches(f"{tmp_path}/t", ["job"])
    for epoch, rows in enumerate(([("a", 5, "new"), ("b", 1, "x")], [("a", 2, "late"), ("b", 1, "again"), ("c", 1, "y")])):
        batch = spark.createDataFrame(rows, "job string, seq long, status string")
        write(batch, epoch)
        write(batch, epoch)
    assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/t/v1").collect()) == [("a", 5, "new"), ("b", 1, "again"), ("c", 1, "y")]
