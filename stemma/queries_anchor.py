"""Queries over anchors of nodes in texts, and their places among blocks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stemma.functions import text as T
from stemma.operators import anchors as A
from stemma.operators import locate as L
from stemma.operators import vectors as N
from stemma.registry import query, table

_NAMES = """names AS (SELECT p_partkey AS node, 0 AS i, trim(p_brand) AS term FROM part WHERE regexp_matches(p_brand, '[0-9]')
    UNION ALL SELECT p_partkey, 2, trim(p_name) FROM part WHERE length(trim(p_name)) >= 4
    UNION ALL SELECT p_partkey, 3, p_type || ' ' || p_size FROM part WHERE length(p_type || ' ' || p_size) >= 4
    UNION ALL SELECT p_partkey, 4, p_type FROM part WHERE length(p_type) >= 4)"""


@query(f"""WITH {_NAMES}, f AS (SELECT *, lower(term) AS key FROM names QUALIFY row_number() OVER (PARTITION BY lower(term) ORDER BY node, i) = 1)
    SELECT key, term, node, row_number() OVER (ORDER BY length(term) DESC, node, i) AS rank FROM f""")
def text_anchors(spark, sf_dir):
    """The names of parts (brand, name, type and size), the first part having each; longest first."""
    parts = table(spark, sf_dir, "part")
    nodes = parts.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("pos"), F.col("p_brand").alias("label"), F.lit(None).cast("string").alias("title_zh"), F.col("p_name").alias("title_en"),
                         F.array(F.concat_ws(" ", "p_type", F.col("p_size").cast("string")), F.col("p_type")).alias("terms"))
    rank = F.row_number().over(Window.orderBy(F.desc("place.length"), "place.pos", "place.id", "place.i"))
    return A.text_anchors(nodes).select("key", "term", "node", rank.cast("long").alias("rank"))


_TERMS = """terms AS (SELECT term, min(item_id) AS node FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS term FROM benchmark) GROUP BY term
        QUALIFY row_number() OVER (PARTITION BY lower(term) ORDER BY min(item_id), term) = 1),
    pat AS (SELECT string_agg(term, '|' ORDER BY length(term) DESC, term) AS pat FROM terms),
    cut AS (SELECT doc_id, regexp_split_to_array(text, pat) AS between, regexp_extract_all(text, pat) AS hits FROM documents, pat WHERE text <> ''),
    ali AS (SELECT doc_id, between, hits, unnest(range(1, len(between) + 1)) AS j FROM cut),
    pcs AS (SELECT doc_id, 2 * j AS o, 'text' AS kind, between[j] AS src FROM ali WHERE between[j] <> '' UNION ALL SELECT doc_id, 2 * j + 1, 'anchor', hits[j] FROM ali WHERE j <= len(hits))"""


@query(f"""WITH {_TERMS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS place, kind, src, CASE WHEN kind = 'anchor' THEN node END AS node
    FROM pcs LEFT JOIN terms ON pcs.src = terms.term AND kind = 'anchor'""")
def anchored_documents(spark, sf_dir):
    """All documents split at the words of benchmark items, each word the first item's that has it."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("term"))
    per = words.groupBy("term").agg(F.min("item_id").alias("node"))
    first = per.groupBy(F.lower("term").alias("key")).agg(F.min(F.struct("node", "term")).alias("f")).select("f.term", "f.node")
    return A.split_by_anchors(table(spark, sf_dir, "documents").select("doc_id", "text"), first)


# Blocks: the turns of conversations, some as headings, rules, numbered statements, environments and formulas. Nodes: one for
# each turn, told in turn by its statement, number, TeX label, title, source or terms.
_FORM = "lower(regexp_replace(coalesce({}, ''), '[\\s$\\\\{{}}*]+', '', 'g'))"
_BLOCKS = """bl AS (SELECT conv_id AS doc_id, turn AS block, CASE WHEN turn % 7 = 5 AND conv_id % 3 = 0 THEN 'h2' WHEN turn % 7 = 6 AND conv_id % 3 = 1 THEN 'hr' ELSE 'paragraph' END AS type,
    CASE turn % 6 WHEN 1 THEN 'Theorem ' || (conv_id % 9 + 1) || '.' || turn || '. ' || text WHEN 2 THEN '\\begin{lemma}{ L-' || turn || ' }' || chr(10) || text WHEN 3 THEN 'see $x_{' || conv_id || '} + y_' || turn || '$ ' || text ELSE text END AS text FROM conversations)"""


def _blocks(spark, sf_dir):
    c, t, text = F.col("conv_id").cast("string"), F.col("turn").cast("string"), F.col("text")
    kind = F.when((F.col("turn") % 7 == 5) & (F.col("conv_id") % 3 == 0), "h2").when((F.col("turn") % 7 == 6) & (F.col("conv_id") % 3 == 1), "hr").otherwise("paragraph")
    said = F.when(F.col("turn") % 6 == 1, F.concat(F.lit("Theorem "), (F.col("conv_id") % 9 + 1).cast("string"), F.lit("."), t, F.lit(". "), text))
    said = said.when(F.col("turn") % 6 == 2, F.concat(F.lit("\\begin{lemma}{ L-"), t, F.lit(" }\n"), text)).when(F.col("turn") % 6 == 3, F.concat(F.lit("see $x_{"), c, F.lit("} + y_"), t, F.lit("$ "), text)).otherwise(text)
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block"), kind.alias("type"), said.alias("text"))


_STATEMENTS = """st AS (SELECT doc_id, block AS node, CASE block % 4 WHEN 0 THEN text || ' ' || coalesce(nxt, '') WHEN 1 THEN substr(text, 1, length(text) * 9 // 10) WHEN 2 THEN substr(text, 1, length(text) // 2) ELSE substr(text, 6) || coalesce(nxt, '') END AS statement
    FROM (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY block) AS nxt FROM bl))"""
_RANGES = f"""fm AS (SELECT doc_id, block, type, {_FORM.format("text")} AS form, sum((type IN ('h2', 'hr'))::INT) OVER (PARTITION BY doc_id ORDER BY block) AS section FROM bl),
    sd AS (SELECT doc_id, node, {_FORM.format("statement")} AS said FROM st WHERE length({_FORM.format("statement")}) >= 8),
    rg AS (SELECT a.doc_id, a.block AS s, b.block AS e, b.form, string_agg(b.form, '') OVER (PARTITION BY a.doc_id, a.block ORDER BY b.block) AS joined FROM fm a JOIN fm b ON a.doc_id = b.doc_id AND a.section = b.section AND b.block >= a.block WHERE a.type <> 'hr' AND b.type <> 'hr'),
    ok AS (SELECT doc_id, node, length(said) AS m, s, e, joined, contains(said, joined) OR contains(joined, said) AS fits, contains(joined, said) AS over FROM rg JOIN sd USING (doc_id) WHERE form <> ''),
    gr AS (SELECT *, bool_and(fits) OVER w AS all_fit, coalesce(bool_or(over) OVER (PARTITION BY doc_id, node, s ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS past FROM ok WINDOW w AS (PARTITION BY doc_id, node, s ORDER BY e)),
    be AS (SELECT *, least(length(joined), m) AS matched, abs(length(joined) - m) AS far, rank() OVER (PARTITION BY doc_id, node ORDER BY least(length(joined), m) DESC, abs(length(joined) - m)) AS r FROM gr WHERE all_fit AND NOT past),
    br AS (SELECT doc_id, node, min(s) AS "start", min(e) AS "end" FROM be WHERE r = 1 GROUP BY doc_id, node HAVING count(*) = 1 AND min(matched) / min(m) >= 0.82 AND min(far) / min(m) <= 0.35)"""


@query(f'WITH {_BLOCKS}, {_STATEMENTS}, {_RANGES} SELECT doc_id, node, "start", "end" FROM br')
def block_ranges(spark, sf_dir):
    """The best range of turns for statements made of two turns, of most or half of one, or of parts of two."""
    b = _blocks(spark, sf_dir)
    w = Window.partitionBy("doc_id").orderBy("block")
    s = b.withColumn("nxt", F.coalesce(F.lead("text").over(w), F.lit("")))
    k = F.col("block") % 4
    said = F.when(k == 0, F.concat("text", F.lit(" "), "nxt")).when(k == 1, F.expr("substr(text, 1, cast(length(text) * 9 div 10 as int))")).when(k == 2, F.expr("substr(text, 1, cast(length(text) div 2 as int))")).otherwise(F.concat(F.expr("substr(text, 6)"), "nxt"))
    return L.block_ranges(s.select("doc_id", F.col("block").alias("node"), said.alias("statement")), b)


_NODES = """nd AS (SELECT conv_id AS doc_id, turn AS node, CASE WHEN turn % 6 = 2 THEN 'Lemma*' ELSE 'theorem' END AS type, CASE WHEN turn % 6 IN (0, 1) THEN 'Theorem ' || (conv_id % 9 + 1) || '.' || (turn // 6 * 6 + 1) END AS label,
    CASE WHEN turn % 6 = 2 THEN 'l-' || turn END AS tex_label, CASE WHEN turn % 6 = 0 OR conv_id % 10 = 7 THEN text END AS statement, CASE WHEN turn % 6 = 4 THEN substr(text, 1, 60) END AS source,
    CASE WHEN turn % 6 = 3 THEN 'X_{' || conv_id || '}+y_' || turn END AS title, CASE WHEN turn % 6 = 5 THEN [substr(text, 3, 9), substr(text, 20, 12), 'absent term'] END AS terms FROM conversations)"""


@query(f"""WITH {_BLOCKS}, {_NODES}, st AS (SELECT doc_id, node, trim(coalesce(statement, '')) AS statement FROM nd), {_RANGES},
    n AS (SELECT doc_id, node, lower(regexp_replace(regexp_replace(type, '\\s+', '', 'g'), '\\*$', '')) AS kind, trim(coalesce(tex_label, label, '')) AS tex, regexp_extract(coalesce(label, ''), '(\\d[\\d.]*)', 1) AS number, trim(coalesce(nd.statement, '')) AS statement,
        {_FORM.format("source")} AS source, lower(regexp_replace(coalesce(title, ''), '[\\s{{}}$\\\\]+', '', 'g')) AS title, list_filter(list_distinct(list_transform(coalesce(terms, []), lambda t: {_FORM.format("t")})), lambda t: length(t) >= 4) AS terms FROM nd),
    b AS (SELECT doc_id, block, text, {_FORM.format("text")} AS form, lower(regexp_extract(string_split(text, chr(10))[1], '\\\\begin\\s*\\{{\\s*([A-Za-z*]+?)\\*?\\s*\\}}', 1)) AS env FROM bl WHERE type <> 'hr'),
    t1 AS (SELECT br.doc_id, br.node, bl.block, 1 AS tier, bl.block = br."start" AS is_first FROM br JOIN bl ON bl.doc_id = br.doc_id AND bl.block BETWEEN br."start" AND br."end"),
    lf AS (SELECT * FROM n WHERE NOT EXISTS (FROM br WHERE br.doc_id = n.doc_id AND br.node = n.node)),
    t2 AS (SELECT doc_id, node, min(block) AS block, 2 AS tier, true AS is_first FROM lf JOIN b USING (doc_id) WHERE tex <> '' AND contains(lower(regexp_replace(regexp_replace(text, '\\{{\\s+', '{{', 'g'), '\\s+\\}}', '}}', 'g')), '{{' || lower(tex) || '}}') AND (kind = '' OR env = '' OR kind = env) GROUP BY doc_id, node),
    fr AS (SELECT * FROM lf WHERE statement = '' AND NOT EXISTS (FROM t2 WHERE t2.doc_id = lf.doc_id AND t2.node = lf.node)),
    t3 AS (SELECT doc_id, node, block, 3 AS tier, true AS is_first FROM fr JOIN b USING (doc_id) WHERE length(source) >= 16 AND length(form) >= 8 AND (contains(form, source) OR contains(source, form)) AND (env <> 'introduction' OR kind = 'introduction')
        QUALIFY row_number() OVER (PARTITION BY doc_id, node ORDER BY abs(length(form) - length(source)) + CASE WHEN env <> '' AND kind <> '' THEN CASE WHEN env = kind THEN -5000 ELSE 5000 END ELSE 0 END, block) = 1),
    fo AS (SELECT DISTINCT doc_id, node FROM (FROM t1 UNION ALL FROM t2 UNION ALL FROM t3)),
    go AS (SELECT n.*, fo.node IS NOT NULL AS found FROM n LEFT JOIN fo USING (doc_id, node) WHERE fo.node IS NOT NULL OR EXISTS (FROM fr WHERE fr.doc_id = n.doc_id AND fr.node = n.node)),
    t4 AS (SELECT doc_id, node, min(block) AS block, 4 AS tier, NOT found AS is_first FROM go JOIN b USING (doc_id) WHERE number <> '' AND regexp_matches(text, '(?i)^\\s*(definition|theorem|lemma|proposition|corollary|example|remark|notation|proof|定义|定理|引理|推论|命题|性质|例子|注)')
        AND regexp_matches(substr(text, 1, 90), '\\b' || replace(number, '.', '\\.') || '\\b') GROUP BY doc_id, node, found),
    g5 AS (SELECT go.* REPLACE (found OR t4.node IS NOT NULL AS found) FROM go LEFT JOIN t4 USING (doc_id, node)),
    mt AS (SELECT doc_id, block, lower(regexp_replace(unnest(regexp_extract_all(text, '\\$([^$\\n]+?)\\$', 1)), '[\\s{{}}$\\\\]+', '', 'g')) AS title FROM b),
    t5 AS (SELECT doc_id, node, min(block) AS block, 5 AS tier, NOT found AS is_first FROM g5 JOIN mt USING (doc_id, title) WHERE length(title) >= 5 GROUP BY doc_id, node, found),
    t6 AS (SELECT doc_id, node, block, 6 AS tier, true AS is_first FROM (SELECT doc_id, node, block, list_filter(terms, lambda t: contains(form, t)) AS hit FROM g5 JOIN b USING (doc_id) WHERE NOT found AND length(form) >= 8 AND NOT EXISTS (FROM t5 WHERE t5.doc_id = g5.doc_id AND t5.node = g5.node))
        WHERE len(hit) > 0 QUALIFY row_number() OVER (PARTITION BY doc_id, node ORDER BY len(hit) DESC, list_max(list_transform(hit, lambda t: length(t))) DESC, block) = 1 AND (len(hit) >= 2 OR list_max(list_transform(hit, lambda t: length(t))) >= 18))
    SELECT doc_id, node, block, tier, is_first FROM (FROM t1 UNION ALL FROM t2 UNION ALL FROM t3 UNION ALL FROM t4 UNION ALL FROM t5 UNION ALL FROM t6) QUALIFY row_number() OVER (PARTITION BY doc_id, node, block ORDER BY tier, is_first) = 1""")
def anchor_index(spark, sf_dir):
    """The blocks of each node, by tiers: statement, TeX label, source, number, title, terms."""
    c = table(spark, sf_dir, "conversations")
    k, conv, turn = F.col("turn") % 6, F.col("conv_id").cast("string"), F.col("turn").cast("string")
    label = F.concat(F.lit("Theorem "), (F.col("conv_id") % 9 + 1).cast("string"), F.lit("."), F.expr("cast(turn div 6 * 6 + 1 as string)"))
    nodes = c.select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("node"), F.when(k == 2, "Lemma*").otherwise("theorem").alias("type"), F.when(k.isin(0, 1), label).alias("label"), F.when(k == 2, F.concat(F.lit("l-"), turn)).alias("tex_label"),
        F.when((k == 0) | (F.col("conv_id") % 10 == 7), F.col("text")).alias("statement"), F.when(k == 4, F.substring("text", 1, 60)).alias("source"), F.when(k == 3, F.concat(F.lit("X_{"), conv, F.lit("}+y_"), turn)).alias("title"),
        F.when(k == 5, F.array(F.substring("text", 3, 9), F.substring("text", 20, 12), F.lit("absent term"))).alias("terms"),
    )
    return L.anchor_index(nodes, _blocks(spark, sf_dir))


# Vectors drawn to every seventh one, so that some are alike: 2 to 2.6 parts of that one and one of their own.
_DRAWN = """dv AS (SELECT e.vec_id AS id, list_transform(list_zip(b.embedding, e.embedding), lambda z: (2.0 + (e.vec_id % 3) * 0.3) * z[1]::DOUBLE + z[2]::DOUBLE) AS v FROM embeddings e JOIN embeddings b ON b.vec_id = e.vec_id - e.vec_id % 7),
    ln AS (SELECT a.id AS x, b.id AS y FROM dv a JOIN dv b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.8)"""


def _drawn(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    base = e.select(F.col("id").alias("at"), F.col("embedding").alias("base"))
    mixed = F.zip_with("base", "embedding", lambda p, q: (F.lit(2.0) + (F.col("id") % 3) * F.lit(0.3)) * p.cast("double") + q.cast("double"))
    return e.withColumn("at", F.col("id") - F.col("id") % 7).join(base, "at").select("id", mixed.alias("embedding"))


@query(f"WITH {_DRAWN} SELECT x, y FROM ln")
def similar_pairs(spark, sf_dir):
    """Every pair of drawn vectors with a cosine of 0.8 or more."""
    return N.similar_pairs(_drawn(spark, sf_dir), 0.8)


@query(f"""WITH RECURSIVE {_DRAWN}, lo AS (SELECT y, list(x) AS lower FROM ln GROUP BY y), od AS (SELECT id, coalesce(lower, []) AS lower, row_number() OVER (ORDER BY id) AS r FROM dv LEFT JOIN lo ON y = id),
    go(r, led) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT od.r, CASE WHEN list_has_any(lower, led) THEN led ELSE list_append(led, id) END FROM go JOIN od ON od.r = go.r + 1),
    la AS (SELECT led FROM go ORDER BY r DESC LIMIT 1)
    SELECT id, coalesce(list_min(list_intersect(lower, led)), id) AS leader FROM od, la""")
def leader_clusters(spark, sf_dir):
    """Drawn vectors claimed one after the other by the first alike."""
    return N.leader_clusters(_drawn(spark, sf_dir), 0.8)


# A chain that needs a round for each link, since its rules stand in reverse; two rules that undo each other; one that never ends.
RULES = [("ion", "io"), ("tio", "ti"), ("enti", "en"), ("qu", "kw"), ("kw", "qu"), ("zz", "z"), ("loser", "loserr")]
_ROUND = "t"
for _p, _r in RULES:
    _ROUND = f"replace({_ROUND}, '{_p}', '{_r}')"


@query(f"""WITH RECURSIVE s AS (SELECT row_number() OVER () AS k, doc_id, text AS t, 0 AS n, false AS done FROM documents UNION ALL
        SELECT k, doc_id, CASE WHEN n < 5 THEN u ELSE t END, n + (n < 5 AND u IS DISTINCT FROM t)::INT, n >= 5 OR u IS NOT DISTINCT FROM t FROM (SELECT *, {_ROUND} AS u FROM s WHERE NOT done))
    SELECT doc_id, n AS rounds, {_ROUND} IS NOT DISTINCT FROM t AS settled, md5(t) AS text FROM s WHERE done""")
def substituted_texts(spark, sf_dir):
    """All documents under rules applied again and again, five rounds at most."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.substituted(F.col("text"), RULES).alias("s"))
    return d.select("doc_id", "s.rounds", "s.settled", F.md5(F.col("s.text").cast("binary")).alias("text"))


_COSINE = "round(list_cosine_similarity({}.embedding::DOUBLE[], {}.embedding::DOUBLE[]), 6)"


@query(f"""WITH fi AS (SELECT q.vec_id AS query, e.vec_id AS id, {_COSINE.format("q", "e")} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE.format("q", "e")} DESC, e.vec_id) AS rank
        FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0 QUALIFY rank <= 5),
    ba AS (SELECT x.vec_id AS id, e.vec_id AS query, row_number() OVER (PARTITION BY x.vec_id ORDER BY {_COSINE.format("x", "e")} DESC, e.vec_id) AS back
        FROM embeddings x JOIN embeddings e ON e.vec_id <> x.vec_id WHERE x.vec_id IN (SELECT id FROM fi) QUALIFY back <= 5)
    SELECT query, id, score, rank, back FROM fi LEFT JOIN ba USING (query, id)""")
def mutual_neighbours(spark, sf_dir):
    """The five nearest of each query vector (ids divisible by 100) among all, and where it stands among theirs."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return N.reciprocal_pairs(e, e.where("id % 100 = 0"))
