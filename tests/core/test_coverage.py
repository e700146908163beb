import pytest
from pyspark.sql import functions as F

from stemma.operators import coverage as C

SOURCE = "# Theorem 1.1\nFirst statement.\n\n# Definition 1.2\nSecond statement.\n\nRemark. This ordinary prose is not a structural candidate.\n"
DOCS = "doc_id long, text string"
BLOCKS = "doc_id long, block long, pos long, role string, hint string, label string, text string"
STATEMENTS = "doc_id long, key long, block string, label string, type string, source_text string, content string"


def block(doc, i, hint, label, text, role=C.TOP_LEVEL):
    return (doc, i, i, role, hint, label, text)


FIRST, SECOND = "# Theorem 1.1\nFirst statement.\n\n", "# Definition 1.2\nSecond statement.\n\n"


def one(spark, blocks, statements, recovered=None, source=SOURCE):
    docs = spark.createDataFrame([(1, source)], DOCS)
    candidates = C.structural_candidates(docs, spark.createDataFrame(blocks, BLOCKS))
    s = spark.createDataFrame(statements, STATEMENTS)
    missing = C.missing_candidates(candidates, s, docs)
    told = spark.createDataFrame(recovered, "doc_id long, candidate_id string, content string") if recovered else missing.select("doc_id", "candidate_id", F.col("source_text").alias("content"))
    return candidates, missing, C.merged_recovery(s, told, candidates, docs)


def test_omission_is_recovered_once(spark):
    blocks = [block(1, 0, "theorem", "Theorem 1.1", FIRST), block(1, 1, "definition", "Definition 1.2", SECOND), block(1, 2, "remark", "", "Remark. This ordinary", "continuation")]
    have = [(1, 0, "0", "Theorem 1.1", "theorem", FIRST, "First statement.")]
    candidates, missing, merged = one(spark, blocks, have, [(1, "block:1", "Second statement.")])
    assert sorted((r.candidate_id, r.origin, r.source_start, r.source_end, r.label) for r in candidates.collect()) == [("block:0", "segment_block", 0, 32, "Theorem 1.1"), ("block:1", "segment_block", 32, 68, "Definition 1.2")]
    assert [r.candidate_id for r in missing.collect()] == ["block:1"]
    assert [(r.new_key, r.label, r.status) for r in merged.orderBy("new_key").collect()] == [(0, "Theorem 1.1", "kept"), (1, "Definition 1.2", "recovered")]


def test_covered_by_source_although_the_label_is_empty(spark):
    blocks = [block(1, 0, "theorem", "Theorem 1.1", FIRST), block(1, 1, "definition", "Definition 1.2", SECOND)]
    have = [(1, 0, "0", "", "theorem", FIRST, "First statement."), (1, 1, "1", "Definition 1.2", "definition", SECOND, "Second statement.")]
    assert one(spark, blocks, have)[1].count() == 0


def test_headings_without_blocks(spark):
    source = "# Example 1.1.9\nExample body.\n\n# Exercise 1.1.14\nExercise body.\n\n# 1.1.6 A section\nSection prose.\n# 定义\n中文定义。\n"
    candidates, missing, _ = one(spark, [], [(1, 0, None, "Example 1-1-9", None, "# Example 1.1.9\nExample body.", "Example body.")], source=source)
    by = {r.label: r for r in candidates.collect()}
    assert set(by) == {"Example 1.1.9", "Exercise 1.1.14", "定义"} and by["Example 1.1.9"].source_end == source.index("# Exercise")
    assert "Exercise" not in by["Example 1.1.9"].source_text
    assert {r.label for r in missing.collect()} == {"Exercise 1.1.14", "定义"}  # its heading has the statement's identity


def test_cursor_goes_forward(spark):
    docs = spark.createDataFrame([(1, "a b. Same. c. Same. d."), (2, "x")], DOCS)
    rows = [(1, 10, 0, "Same."), (1, 11, 1, "Same."), (1, 12, 2, "a b."), (1, 13, 3, " c. \n"), (1, 14, 4, "absent"), (1, 15, 5, " "), (1, 16, 6, None), (2, 17, 0, "x")]
    got = C.located(spark.createDataFrame(rows, "doc_id long, block long, pos long, text string"), docs).collect()
    assert {r.block: (r.source_start, r.source_end) for r in got} == {10: (5, 10), 11: (14, 19), 12: (0, 4), 13: (11, 13), 14: (-1, -1), 15: (13, 14), 16: (-1, -1), 17: (0, 1)}


def test_duplicates_of_all_three_kinds(spark):
    source = "# Lemma 1\nSame words.\n\n# Lemma 2\nOther words.\n\n# Lemma 3\nLast words.\n"
    a, b, c = source.split("\n\n")[0] + "\n\n", source.split("\n\n")[1] + "\n\n", source.split("\n\n")[2]
    blocks = [block(1, 0, "lemma", "Lemma 1", a), block(1, 1, "lemma", "", "Other words."), block(1, 2, "theorem", "T", "Last words.")]
    have = [(1, 0, "0", "Lemma 1", "lemma", a, "Same words."), (1, 1, None, "x", "claim", "Other words.", "Other  words.")]
    told = [(1, "block:0", "Same words."), (1, "block:1", "# Lemma 2\nOther words。"), (1, "block:2", "Last words."), (1, "heading:35", "never asked"), (1, f"heading:{source.index('# Lemma 3')}", "Last words.")]
    candidates, _, merged = one(spark, blocks, have, told, source)
    assert {f"heading:{source.index('# Lemma 2')}", f"heading:{source.index('# Lemma 3')}"} <= {r.candidate_id for r in candidates.collect()}
    got = {(r.candidate_id, r.status): r.new_key for r in merged.collect() if r.candidate_id}
    # block 0 is there; block 1 says what statement 1 says at its place; of Lemma 3 the heading comes first and block 2 repeats it
    assert got == {("block:0", "duplicate"): None, ("block:1", "duplicate"): None, (f"heading:{source.index('# Lemma 3')}", "recovered"): 2, ("block:2", "duplicate"): None}


def test_identities(spark):
    rows = [("Theorem 2-1", "定理"), ("# Lemma 3.A.", None), ("Main  Result :", None), ("定义", "定义"), (None, "remark"), ("3.1", "odd"), (None, None), ("Ｌｅｍｍａ　４", None)]
    got = spark.createDataFrame(rows, "label string, type string").select(C.label_identity(F.col("label"), F.col("type")).alias("i"))
    assert [r.i for r in got.collect()] == ["theorem:2.1", "lemma:3.a", "label:main result", "definition:unnumbered", "remark:unnumbered", "label:3.1", "label:", "lemma:4"]
    prints = spark.createDataFrame([("# H\nLet  x，y",), ("a\n ## H b\nc",), (None,), ("Ａ（1）",)], "t string").select(C.surface_fingerprint(F.col("t")).alias("p"))
    assert [r.p for r in prints.collect()] == ["Letx,y", "ac", "", "A(1)"]


def test_source_only(spark):
    rows = [(1, "block:1", "some text", 3, 12), (1, "block:2", "none", -1, -1)]
    df = spark.createDataFrame(rows, "doc_id long, candidate_id string, source_text string, source_start long, source_end long")
    assert C.source_only(df.limit(1)).first().content == "some text"
    with pytest.raises(Exception, match="no trusted source span"):
        C.source_only(df).collect()


def test_parts_of_an_expression_are_found_once(spark):
    """Repeated parts multiplied the plans, and with them the driver's memory, and ran again for each row."""
    span = C.source_span(F.col("a"), F.col("b"), F.col("c"))._jc.toString()
    assert span.count("locate") <= 4
    identity = C.label_identity(F.col("a"), F.col("b"))._jc.toString()
    assert identity.count("nfkc") <= 2 and identity.count("regexp_extract") <= 1
    rows = spark.createDataFrame([("Ｔheorem ２-1.", None), ("Lemma ５．", "定理"), (None, None), ("  # Claim  x:", "claim")], "label string, type string")
    assert [r[0] for r in rows.select(C.label_identity(F.col("label"), F.col("type"))).collect()] == ["theorem:2.1", "theorem:5", "label:", "claim:unnumbered"]
