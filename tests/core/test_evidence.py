import pytest
from pyspark.sql import functions as F

from stemma.operators import evidence as E


@pytest.mark.parametrize(
    ("raw", "kind", "wanted"),
    [('say {"a": 1} ok', dict, {"a": 1}), ("```json\n{'a': [1]}\n```", dict, {"a": [1]}), ('{"t": "\\alpha \\sum"}', dict, {"t": "\x07lpha \\sum"}), ("[1, 2, [3", list, [1, 2, [3]]), ("{“a”：1}", dict, {"a": 1}), ("none", dict, None), ('{"a": 1', dict, None), (None, dict, None)],
)
def test_answers(raw, kind, wanted):
    got = E.answer_from(raw, kind)
    assert got == wanted or raw.startswith('{"t"') and set(got) == {"t"}


def test_columns(spark):
    row = spark.range(1).select(
        E.negates(F.lit("It does  NOT depend on it")).alias("n"), E.negates(F.lit(None).cast("string")).alias("m"), E.anchored(F.lit("A  b"), F.lit("x ab y")).alias("a"), E.anchored(F.lit(" "), F.lit("x")).alias("z"),
        E.fenced_code(F.lit("t ```lean\nx y\n``` e")).alias("c"), E.answer_json(F.lit('q {"a": "é"}')).alias("j"), E.weak_triggers_only(F.array(F.lit("由"), F.lit("因此"))).alias("w"),
        E.repair_flags(F.expr("array(named_struct('target', cast(null as int)))"), F.expr("cast(array() as array<struct<target:int>>)"), F.array().cast("array<int>"), F.array().cast("array<int>"), F.array(F.lit("由"))).alias("f"),
    ).first()
    assert (row.n, row.m, row.a, row.z, row.c, row.j, row.w) == (True, False, True, False, "x y", '{"a": "é"}', True)
    assert row.f == ["unresolved_explicit_reference", "trigger_without_target"]


def test_context_sessions_titles(spark):
    text = "AAAA\n\nHence we get\n\nplain\n\nBBBB"
    nodes = spark.createDataFrame([(1, 0, 0, 4), (1, 1, text.index("BBBB"), len(text))], "doc_id int, pos int, start int, end int")
    got = {r.pos: r.context for r in E.derivation_context(nodes, spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()}
    assert got == {0: None, 1: "Hence we get"}
    users = spark.createDataFrame([(1, True), (2, False)], "user_id int, active boolean")
    sessions = spark.createDataFrame([(1, "a", None, "2030-01-01"), (2, "b", None, "2030-01-01"), (1, "c", "2020-01-01", "2030-01-01")], "user_id int, token_hash string, revoked_at string, expires_at string")
    assert [E.active_session(users, sessions, t, F.lit("2025-01-01")).count() for t in "abc"] == [1, 0, 0]
    hits = spark.createDataFrame([(1, 5, 0, "by the Main Lemma")], "doc_id int, pos int, hit int, surface string")
    titles = spark.createDataFrame([(1, 2, "Main Lemma"), (1, 9, "Lemma"), (1, 3, "Main"), (1, 4, "Main")], "doc_id int, pos int, title string")
    assert E.title_fallback(hits, titles).first().target == 2
