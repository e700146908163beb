"""Queries over the coverage of documents by statements: every order is a document, its items its headings and prose."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stemma.operators import coverage as C
from stemma.plans.state import written
from stemma.registry import query, table

# An item is a theorem, a definition or a lemma under a heading, prose, or a section; lemmas are all alike. Three in four are
# blocks that count. Of what states something a third has a statement by block, a third one by its source, a third none.
_ITEMS = """it AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS i, l_partkey AS p, l_suppkey AS s FROM lineitem),
    tx AS (SELECT *, p % 5 AS k, CASE WHEN p % 5 < 3 THEN p // 5 % 3 END AS had, CASE p % 5 WHEN 0 THEN '# Theorem ' || (s % 9 + 1) || '.' || i WHEN 1 THEN '## Definition ' || i WHEN 2 THEN '# Lemma' WHEN 4 THEN '# ' || i || ' Section' END AS head,
        CASE p % 5 WHEN 0 THEN 'Statement ' || p || '.' WHEN 1 THEN 'Some notion.' WHEN 2 THEN 'Same words.' WHEN 3 THEN 'Plain prose of part ' || (p % 3) || '.' ELSE 'Words.' END AS body FROM it),
    ct AS (SELECT *, coalesce(head || chr(10), '') || body || chr(10) || chr(10) AS text, CASE k WHEN 0 THEN 'theorem:' || (s % 9 + 1) || '.' || i WHEN 1 THEN 'definition:' || i WHEN 2 THEN 'lemma:unnumbered' END AS ident,
        CASE k WHEN 0 THEN 'Theorem' WHEN 1 THEN 'Definition' WHEN 2 THEN 'Lemma' END AS kind FROM tx),
    dc AS (SELECT doc_id, string_agg(text, '' ORDER BY i) AS whole FROM ct GROUP BY doc_id),
    ob AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM ct WHERE k < 3 AND s % 4 <> 0),
    lo AS (SELECT doc_id, 0::BIGINT AS n, 0::BIGINT AS i, 0::BIGINT AS "start", 0::BIGINT AS "end" FROM dc UNION ALL
        SELECT ob.doc_id, ob.n, ob.i, f, f + length(ob.text) FROM lo JOIN ob ON ob.doc_id = lo.doc_id AND ob.n = lo.n + 1 JOIN dc ON dc.doc_id = ob.doc_id,
        LATERAL (SELECT CASE WHEN strpos(substr(whole, lo."end" + 1), ob.text) > 0 THEN lo."end" + strpos(substr(whole, lo."end" + 1), ob.text) - 1 ELSE strpos(whole, ob.text) - 1 END AS f))"""


def _items(spark, sf_dir):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    it = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(order).cast("long").alias("i"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    k, text = F.col("p") % 5, lambda c: c.cast("string")
    head = F.when(k == 0, F.concat(F.lit("# Theorem "), text(F.col("s") % 9 + 1), F.lit("."), text(F.col("i")))).when(k == 1, F.concat(F.lit("## Definition "), text(F.col("i")))).when(k == 2, "# Lemma").when(k == 4, F.concat(F.lit("# "), text(F.col("i")), F.lit(" Section")))
    body = F.when(k == 0, F.concat(F.lit("Statement "), text(F.col("p")), F.lit("."))).when(k == 1, "Some notion.").when(k == 2, "Same words.").when(k == 3, F.concat(F.lit("Plain prose of part "), text(F.col("p") % 3), F.lit("."))).otherwise("Words.")
    had = F.when(k < 3, F.expr("p div 5 % 3"))
    it = it.withColumns({"k": k, "had": had, "head": head, "body": body})
    return it.withColumn("text", F.concat(F.coalesce(F.concat("head", F.lit("\n")), F.lit("")), "body", F.lit("\n\n")))


def _documents(items):
    return items.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), "").alias("text"))


def _blocks(items):
    hint = F.when(F.col("k") == 0, "theorem").when(F.col("k") == 1, "Definition").when(F.col("k") == 2, "lemma")
    role = F.when(F.col("s") % 4 == 0, "continuation").otherwise(C.TOP_LEVEL)
    return items.select("doc_id", F.col("i").alias("block"), F.col("i").alias("pos"), role.alias("role"), hint.alias("hint"), F.concat(F.lit("label "), F.col("i").cast("string")).alias("label"), "text")


def _statements(items):
    kind = F.when(F.col("k") == 0, "theorem").when(F.col("k") == 1, "定义").otherwise("lemma")
    label = F.when(F.col("had") == 1, F.regexp_replace("head", "\\.(\\d+)$", "-$1")).otherwise("")
    rows = items.where("had < 2")
    return rows.select("doc_id", F.col("i").alias("key"), F.when(F.col("had") == 0, F.col("i").cast("string")).alias("block"), label.alias("label"), kind.alias("type"), F.col("text").alias("source_text"), F.col("body").alias("content"))


@query(f'WITH RECURSIVE {_ITEMS} SELECT doc_id, i AS block, "start", "end" FROM lo WHERE n > 0')
def located_blocks(spark, sf_dir):
    """Where each block that counts is found in its document, looking onward from the one before."""
    items = _items(spark, sf_dir)
    own = _blocks(items).where((F.col("role") == C.TOP_LEVEL) & F.col("hint").isNotNull())
    return C.located(own, _documents(items)).select("doc_id", "block", F.col("source_start").alias("start"), F.col("source_end").alias("end"))


_CANDIDATES = f"""{_ITEMS}, pl AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM ct),
    hd AS (SELECT pl.*, coalesce(lead(place) OVER (PARTITION BY doc_id ORDER BY i), length(whole)) AS upto FROM pl JOIN dc USING (doc_id) WHERE k <> 3),
    sg AS (SELECT lo.doc_id, 'block:' || lo.i AS candidate_id, lo.i, "start", "end", CASE WHEN k = 2 THEN 'Lemma S' ELSE trim(head, '# ') END AS label, kind AS type, ident, body FROM lo JOIN ct ON ct.doc_id = lo.doc_id AND ct.i = lo.i WHERE lo.n > 0),
    ca AS (SELECT doc_id, candidate_id, i AS block, "start", "end", label, type, ident, body FROM sg UNION ALL
        SELECT doc_id, 'heading:' || place, NULL, place, upto, trim(head, '# '), kind, ident, body FROM hd WHERE k < 3 AND NOT EXISTS (FROM sg WHERE sg.doc_id = hd.doc_id AND sg.ident = hd.ident AND sg."start" <= hd.place AND hd.place < sg."end"))"""


@query(f'WITH RECURSIVE {_CANDIDATES} SELECT doc_id, candidate_id, block::VARCHAR AS block, "start", "end", label, type FROM ca')
def structural_candidates(spark, sf_dir):
    """What each document must state: its blocks that count, and headings that no such block covers."""
    items = _items(spark, sf_dir)
    got = C.structural_candidates(_documents(items), _blocks(items))
    return got.select("doc_id", "candidate_id", "block", F.col("source_start").alias("start"), F.col("source_end").alias("end"), "label", "type")


_MISSING = f"""{_CANDIDATES}, st AS (SELECT ct.doc_id, i, had, k, text, head, body, ident, strpos(whole, text) - 1 AS place FROM ct JOIN dc USING (doc_id) WHERE had < 2),
    ke AS (SELECT DISTINCT doc_id, place, ident FROM st WHERE had = 1 OR k = 2),
    mi AS (SELECT * FROM ca WHERE NOT EXISTS (FROM st WHERE st.doc_id = ca.doc_id AND st.had = 0 AND st.i = ca.block) AND (block IS NOT NULL OR NOT EXISTS (FROM ke WHERE ke.doc_id = ca.doc_id AND ke.place = ca."start" AND ke.ident = ca.ident)))"""


@query(f"WITH RECURSIVE {_MISSING} SELECT doc_id, candidate_id, label, type FROM mi")
def uncovered_candidates(spark, sf_dir):
    """What no statement covers, by its block or by its heading's place and identity."""
    items = written(_items(spark, sf_dir), "items")
    docs = written(_documents(items), "documents")
    return C.missing_candidates(C.structural_candidates(docs, _blocks(items)), _statements(items), docs).select("doc_id", "candidate_id", "label", "type")


@query(f"""WITH RECURSIVE {_MISSING},
    rc AS (SELECT mi.*, EXISTS (FROM ke WHERE ke.doc_id = mi.doc_id AND ke.place = mi."start" AND ke.ident = mi.ident) OR EXISTS (FROM st WHERE st.doc_id = mi.doc_id AND replace(st.body, ' ', '') = replace(mi.body, ' ', '') AND st.place < mi."end" AND mi."start" < st.place + length(st.text)) AS again FROM mi),
    ev AS (SELECT doc_id, i AS key, NULL::VARCHAR AS candidate_id, CASE WHEN had = 1 THEN regexp_replace(head, '\\.(\\d+)$', '-\\1') ELSE '' END AS label, CASE k WHEN 0 THEN 'theorem' WHEN 1 THEN '定义' ELSE 'lemma' END AS type, body AS content, 'kept' AS status, place, 0 AS of FROM st
        UNION ALL SELECT doc_id, NULL::BIGINT, candidate_id, label, type, body, CASE WHEN again THEN 'duplicate' ELSE 'recovered' END, "start", 1 FROM rc),
    tc AS (SELECT *, bool_or(status = 'recovered') OVER (PARTITION BY doc_id) AS touched FROM ev)
    SELECT doc_id, CASE WHEN status <> 'duplicate' THEN row_number() OVER (PARTITION BY doc_id, status = 'duplicate' ORDER BY CASE WHEN touched THEN place ELSE 0 END, of, key, place, candidate_id) - 1 END AS new_key, key, candidate_id, label, type, content, status FROM tc""")
def coverage_recovery(spark, sf_dir):
    """Statements with what was recovered of the uncovered, once each, in the order of their sources."""
    items = written(_items(spark, sf_dir), "items")
    docs, statements = written(_documents(items), "documents"), _statements(items)
    candidates = written(C.structural_candidates(docs, _blocks(items)), "candidates")
    missing = written(C.missing_candidates(candidates, statements, docs), "missing")
    told = missing.select("doc_id", "candidate_id", F.expr("regexp_extract(source_text, '(?s)^#+[^\\\\n]*\\\\n([^\\\\n]*)', 1)").alias("content"))
    return C.merged_recovery(statements, told, candidates, docs)
