import random

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def documents(spark, folder):
    rng = random.Random(2)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(n))
    item = prose(20)
    passage = prose(60)
    rows = [(i, prose(rng.randrange(80, 200)), "en", "s") for i in range(60)]
    base = prose(150).split()
    near = list(base)
    near[75] = "changed"
    rows += [(100, " ".join(base), "en", "s"), (101, " ".join(near), "en", "s"), (102, " ".join(base), "en", "s")]
    rows += [(110, f"{prose(100)} {passage} {prose(100)}", "en", "s"), (111, f"{prose(100)} {passage} {prose(100)}", "en", "s")]
    rows += [(120, f"{prose(50)} {item} {prose(50)}", "en", "s"), (121, f"{prose(600)} {item} {prose(600)}", "en", "s")]
    rows += [(130, " ".join(w + "***" for w in prose(100).split()), "en", "s"), (131, "too short", "en", "s"), (132, None, "en", "s"), (None, prose(90), "en", None), (7, rows[7][1], "en", "s")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {r[0]: r[1] for r in rows}, item, passage


def test_stages(spark, tmp_path):
    texts, item, passage = documents(spark, f"file://{tmp_path}")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.schema(docs.schema).parquet(f"{tmp_path}/{name}")
        seen[name] = [(r.doc_id, r.text, r.n_chars) for r in docs.collect()]
    ids = {k: [d for d, _, _ in v] for k, v in seen.items()}
    assert not {130, 131, 132} & set(ids["quality_rules"]) and {*range(60), None} <= set(ids["quality_rules"])
    assert not {101, 102} & set(ids["near_dup"]) and 100 in ids["near_dup"] and ids["near_dup"].count(7) == 1
    after = {d: t for d, t, _ in seen["suffix_dedup"]}
    assert passage in after[110] and passage not in after[111] and len(after[111]) < len(texts[111]) - 300
    assert 120 not in ids["decontaminate"] and 121 in ids["decontaminate"]
    cleaned = {d: (t, n) for d, t, n in seen["decontaminate"]}
    assert item not in cleaned[121][0] and cleaned[121][1] == len(cleaned[121][0])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted(r.sequence_id for r in packed) == list(range(len(packed)))
    assert {r.doc_id for r in packed} == set(ids["decontaminate"]) and all(len(np.frombuffer(r.ids, "<u4")) == r.length for r in packed)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)


def test_clashing_columns_empty_tables_and_long_texts(spark, tmp_path):
    rng = random.Random(5)
    spark.createDataFrame([(1, "one two")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(120_000))
    rows = [(1, long, "en", "s", len(long), "x", 5, 1), (2, long + " more", "en", "s", 0, "x", 5, 1), (3, None, None, None, None, None, None, None), (None, long[:900], "en", "s", 900, "x", 5, 1)]
    spark.conf.set("spark.sql.caseSensitive", "true")  # to make a table whose names differ only in case
    wide = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, TEXT string, text_hash int, Kept int")
    spark.conf.unset("spark.sql.caseSensitive")
    for docs in (wide, wide.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == list(corpus_pipeline.COLUMNS), name
            if docs is not wide:
                assert out.count() == 0
            elif name == "near_dup":
                assert {r.doc_id for r in out.collect()} == {1, 3, None}
            elif name == "suffix_dedup":
                got = {r.doc_id: r.n_chars for r in out.collect()}
                assert got[2] < 200 and got[3] is None and len(got) == 4
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ({1, 2, 3, None} if docs is wide else set())


def test_near_dup_keeps_rows_of_no_class(spark, tmp_path):
    """Null ids and wordless texts stay, row by row, also where another doc_id comes twice; rows alike in id and text leave one."""
    prose = " ".join(f"word{i}" for i in range(60))
    alone = [(None, prose, "en", "s", 1), (None, prose, "en", "s", 1), (3, " ", "en", "s", 1), (3, " ", "en", "s", 1), (4, None, "en", "s", None), (4, None, "en", "s", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    twice = [(8, prose, "fr", "s", 2), (8, prose, "en", "t", 2), (8, prose, "en", None, 2), (8, prose, "en", None, 2), (9, prose + " more", "en", "s", 2)]
    for more, stay in (([], []), (twice, [(8, prose, "en", None, 2)])):
        out = corpus_pipeline.near_dup(spark, spark.createDataFrame(alone + more, schema), str(tmp_path))
        assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, alone + stay))
