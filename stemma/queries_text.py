"""Queries over labels, references and units of statements: literal samples that meet every case, beside the driver's texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stemma.functions import references as X
from stemma.functions import text as T
from stemma.functions import types as K
from stemma.operators import graph as G
from stemma.operators import relational as R
from stemma.operators import resolve
from stemma.operators import segment as S
from stemma.registry import Sample, query, table

LABELS = Sample("labels_", {"id": "int", "label": "string", "title": "string"}, [
    (1, "定理 2.1", "中值定理与应用"), (2, "Theorem 3.2(a)", "mean"), (3, " 引理（1．2） ", None), (4, "Lemmas 7", "The long title"), (5, "remark 4", "注记"), (6, None, None),
    (7, "", " "), (8, "定义2-1", "群，环 (域)"), (9, "axiom 1.2.3", "x_1 + y"), (10, "推论 5(b)", "A—B c"),
])
UNITS = Sample("units_", {"id": "int", "text": "string"}, [
    (0, "# Theorem 2.1 (Main)\nx"), (1, "## 3. Results"), (2, "Lemma A. text"), (3, "(2.3) Let x"), (4, "\\tag{5} y"), (5, "plain words"), (6, None), (7, "Proof. By Theorem 2\n\n"), (8, "### Example"),
    (9, "  \n\n#### Definition 1.2 - groups"), (10, "第3章 群论"), (11, "证明：由定理"), (12, "(ii) second case"), (13, "（a） case"), (14, "Theorem 4 follows; see Lemma 5"), (15, "as Corollary 7 says"), (16, "A12 tagged"),
    (17, "1.2. numbered start"), (18, "Chapter 4"), (19, "#### ??? notes"), (20, "# Lemma: short"), (21, "定理 3. 设 x"), (22, "according to Definition 2.3 we see"), (23, "![i](u) only"),
])
MENTIONS = Sample("mentions", {"id": "int", "text": "string"}, [
    (1, "由定理 2.1 和定义3(a)可知, 上述引理成立"), (2, "By Theorem 4 and lemmas 5.2, see \\cref{a, b,,c} and \\eqref{q}"), (3, "根据 Cauchy-Schwarz 不等式与公式(2.1), 上式, equation (*) and Eq. (IV)"), (4, "\\hyperref[x,y] \\ref{z} \\nothing{w}"),
    (5, None), (6, ""), (7, "no reference at all"), (8, "前述命题, 下式, 利用 Jordan–Hölder 定理; 推论§ 8-2"), (9, "于是 故 得到 同理可得"), (10, "式（3） 式 ( 12-3 )"),
])
_ZH, _EN = "定义|定理|命题|引理|推论|性质|公理", "definition|theorem|proposition|lemma|corollary|property|axiom"
_KINDS, _KINDS_ZH = "|".join(X.LOGICAL_TYPES), "|".join(X.LOGICAL_TYPES_ZH)
_NUMBERS = "(?:[A-Za-z]?\\d+(?:[.\\-][A-Za-z0-9]+)*|[IVXLCDM]+|[A-Z])"
_NORMAL = "regexp_replace(translate(coalesce(label, ''), '（）．', '().'), '\\s+', '', 'g')"
_ZH_OF = "CASE lower(n) " + " ".join(f"WHEN '{en}' THEN '{zh}'" for en, zh in X.TYPES.items()) + " ELSE n END"


@query(f"""WITH {LABELS.sql} SELECT id, {_NORMAL} AS normal, trim(regexp_replace(translate(coalesce(label, ''), '（）．', '().'), '[^0-9A-Za-z\\x{{4e00}}-\\x{{9fff}}]+', ' ', 'g')) AS free FROM labels_
    UNION ALL SELECT doc_id::INT + 1000, regexp_replace(source, '\\s+', '', 'g'), trim(regexp_replace(source, '[^0-9A-Za-z\\x{{4e00}}-\\x{{9fff}}]+', ' ', 'g')) FROM documents""")
def normal_labels(spark, sf_dir):
    """Labels without white space and full-width signs, and as free text."""
    rows = LABELS.frame(spark).select("id", "label").unionByName(table(spark, sf_dir, "documents").select((F.col("doc_id").cast("int") + 1000).alias("id"), F.coalesce("source", F.lit("")).alias("label")))
    return rows.select("id", X.normal_label(F.col("label")).alias("normal"), X.free_text(F.col("label")).alias("free"))


_PARSED = f"""p AS (SELECT id, label, title, nullif(regexp_extract(s, pat, 1), '') AS n, nullif(regexp_extract(s, pat, 2), '') AS number
    FROM (SELECT *, {_NORMAL} AS s, '(?i)^({_ZH}|{_EN})s?([0-9]+(?:[.\\-][0-9]+)*(?:\\([a-zA-Z0-9]+\\))?)$' AS pat FROM labels_)),
    z AS (SELECT id, label, title, {_ZH_OF} AS type, number FROM p)"""


@query(f"WITH {LABELS.sql}, {_PARSED} SELECT id, type, number FROM z")
def parsed_labels(spark, sf_dir):
    """Type, by its Chinese name, and number of each label."""
    return LABELS.frame(spark).select("id", X.parsed_label(F.col("label")).alias("p")).select("id", "p.type", "p.number")


@query(f"""WITH {LABELS.sql}, {_PARSED}, e AS (SELECT *, CASE type {" ".join(f"WHEN '{zh}' THEN '{en.capitalize()}'" for en, zh in X.TYPES.items())} END AS en, {_NORMAL} AS s FROM z),
    a AS (SELECT id, unnest([trim(label), s, CASE WHEN length(trim(title)) >= 4 THEN trim(title) END, type || ' ' || number, type || number, en || ' ' || number, en || number,
    'T ' || type || ' ' || number, 'T' || type || number, type || ' ' || number || ' T', type || number || 'T', 'T ' || en || ' ' || number, 'T' || en || number, en || ' ' || number || ' T', en || number || 'T']) AS alias FROM e)
    SELECT DISTINCT id, alias FROM a WHERE alias IS NOT NULL AND alias <> ''""")
def alias_expansion(spark, sf_dir):
    """The ways in which each label and title can be named, with the anchor term T."""
    return LABELS.frame(spark).select("id", F.explode(X.aliases(F.col("label"), F.col("title"), F.array(F.lit("T")))).alias("alias"))


@query(f"""WITH {MENTIONS.sql}, t AS (SELECT id, coalesce(text, '') AS t FROM mentions UNION ALL SELECT doc_id::INT + 1000, coalesce(text, '') FROM documents),
    c AS (SELECT id, len(regexp_extract_all(t, '(?:{_ZH})\\s*§?\\s*[0-9]+(?:[.\\-][0-9]+)*')) + len(regexp_extract_all(t, '(?i)(?:{_EN})s?\\s*[0-9]+(?:[.\\-][0-9]+)*')) AS explicit,
    len(list_filter(flatten(list_transform(regexp_extract_all(t, '\\\\(?:ref|eqref|autoref|cref|Cref|nameref)\\s*\\{{([^{{}}]+)\\}}', 1) || regexp_extract_all(t, '\\\\hyperref\\s*\\[([^\\[\\]]+)\\]', 1), lambda x: string_split(x, ','))), lambda x: trim(x) <> '')) AS tex,
    len(regexp_extract_all(t, '(?i)(?:式|公式|equation|eq\\.?)\\s*[\\(（]\\s*(?:[0-9]+(?:[.\\-][0-9]+)*|[*∗★]+|[IVX]+)\\s*[\\)）]')) AS formula, len(regexp_extract_all(t, '上式|下式|上面式子|前式|前一式')) AS relative_formula,
    len(regexp_extract_all(t, '(?:上述|前述)(?:{_ZH})')) AS relative, len(regexp_extract_all(t, '(?:由|根据|利用|应用|依据|按照)\\s*[A-Z][A-Za-z\\-]+(?:\\s*[-–]\\s*[A-Z][A-Za-z\\-]+)?\\s*(?:不等式|定理|引理|公式|法则|原理|恒等式)')) AS named FROM t)
    SELECT id, explicit, tex, formula, relative_formula, relative, named FROM c""")
def reference_kinds(spark, sf_dir):
    """Explicit, TeX, formula, relative and named references in each text."""
    rows = MENTIONS.frame(spark).unionByName(table(spark, sf_dir, "documents").select((F.col("doc_id").cast("int") + 1000).alias("id"), "text"))
    kinds = F.transform(X.reference_hits("text"), lambda h: h["kind"])
    hits = rows.select("id", kinds.alias("k"))
    return hits.select("id", *[(F.size("k") - F.size(F.array_remove("k", k))).cast("long").alias(k) for k in ("explicit", "tex", "formula", "relative_formula", "relative", "named")])


_VERBS = ", ".join(f"'{v}'" for v in dict.fromkeys(X.REFERENCE_VERBS + X.DEDUCTION_VERBS))


@query(f"WITH {MENTIONS.sql} SELECT id, array_to_string(list_filter([{_VERBS}], lambda v: contains(coalesce(text, ''), v)), ',') AS triggers FROM mentions")
def trigger_words(spark, sf_dir):
    """Reference and deduction verbs of each mention."""
    return MENTIONS.frame(spark).select("id", F.array_join(X.triggers(F.col("text")), ",").alias("triggers"))


@query(f"""WITH {UNITS.sql}, t AS (SELECT id, regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') AS t, coalesce(text, '') AS raw FROM units_ UNION ALL SELECT doc_id::INT + 1000, regexp_replace(text, '^\\s+|\\s+$', '', 'g'), text FROM documents)
    SELECT id, array_to_string(list_filter([CASE WHEN id = 0 THEN 'document_initial' END, CASE WHEN regexp_matches(t, '(?i)^(#{{1,6}}\\s|(?:chapter|section|appendix)\\b|第.+[章节])') THEN 'heading_like' END,
    CASE WHEN regexp_matches(t, '(?i)^(proof|证明|证)([^\\pL\\pN_]|$)') THEN 'proof_like' END, CASE WHEN regexp_matches(t, '(?i)^([(（][a-zivxlcdm0-9]+[)）]|[a-zivxlcdm][)])\\s') THEN 'subpart_like' END,
    CASE WHEN regexp_matches(regexp_extract(t, '(?is)^(.*?)\\b(?:{_KINDS})\\s+{_NUMBERS}\\b', 1), '(?i)(^|[^\\pL\\pN_])(?:by|see|from|using|according\\s+to|apply|follows\\s+from|theorem|lemma|proposition|corollary|definition|reference|参见|由|根据)([^\\pL\\pN_]|$)') THEN 'embedded_reference' END,
    CASE WHEN contains(raw, chr(10) || chr(10)) THEN 'paragraph_boundary' END], lambda f: f IS NOT NULL), ',') AS flags FROM t""")
def boundary_evidence(spark, sf_dir):
    """Boundary evidence of sample units and of documents."""
    rows = UNITS.frame(spark).unionByName(table(spark, sf_dir, "documents").select((F.col("doc_id").cast("int") + 1000).alias("id"), F.coalesce("text", F.lit("")).alias("text")))
    return rows.select("id", F.array_join(X.unit_flags(F.col("text"), F.col("id") == 0), ",").alias("flags"))


_HEAD = f"""l AS (SELECT id, coalesce(text, '') AS t, trim(regexp_extract(coalesce(text, ''), '^\\s*([^\\n]*)', 1)) AS line FROM units_),
    b AS (SELECT *, regexp_matches(line, '^#{{1,6}}\\s+\\S') AS is_heading, regexp_replace(line, '^#{{1,6}}\\s+', '') AS body FROM l),
    k AS (SELECT *, regexp_extract(body, '(?i)^(?:{_KINDS})([^A-Za-z]|$)', 0) AS k0 FROM b),
    n AS (SELECT *, CASE WHEN k0 = '' THEN '' ELSE regexp_extract(k0, '^[A-Za-z]+') END AS kind FROM k),
    m AS (SELECT *, ltrim(substr(body, length(kind) + 1)) AS after FROM n),
    o AS (SELECT *, regexp_extract(after, '^({_NUMBERS})(?:[\\s.:：(–-]|$)', 1) AS number FROM m),
    r AS (SELECT *, regexp_replace(ltrim(substr(after, length(number) + 1)), '^\\.\\s*', '') AS rest FROM o),
    h AS (SELECT *, is_heading AND kind <> '' AND (rest = '' OR regexp_matches(rest, '^\\([^)]*\\)$') OR regexp_matches(rest, '^[-–:：]')) AS logical FROM r)"""


@query(f"""WITH {UNITS.sql}, {_HEAD} SELECT id, CASE WHEN logical THEN 'logical' WHEN is_heading THEN 'section' END AS kind, CASE WHEN logical THEN lower(kind) END AS type, CASE WHEN logical THEN nullif(number, '') END AS number,
    CASE WHEN logical THEN regexp_replace(rest, '^[\\s\\-–:：]+|[\\s\\-–:：]+$', '', 'g') WHEN is_heading THEN regexp_replace(body, '^\\d+(?:\\.\\d+)*\\.?\\s+', '') END AS title FROM h""")
def parsed_headings(spark, sf_dir):
    """Kind, type, number and title of the heading that opens each sample unit."""
    return UNITS.frame(spark).select("id", X.heading(F.col("text")).alias("h")).select("id", "h.*")


@query(f"""WITH {UNITS.sql}, {_HEAD}, f AS (SELECT id, is_heading, logical, lower(kind) AS kind, number, coalesce(nullif(regexp_extract(trim(t), '^(\\\\(?:tag|label)\\{{[^{{}}]+\\}})', 1), ''), regexp_extract(trim(t), '^([A-Z]\\d+)', 1)) AS custom,
    regexp_extract(trim(t), '^(\\([A-Za-z0-9]+(?:[.\\-][A-Za-z0-9]+)*\\)|[A-Za-z0-9]+(?:[.\\-][A-Za-z0-9]+)+[.:]?)\\s', 1) AS numeric, rtrim(regexp_extract(trim(t), '(?i)^((?:{_KINDS}|{_KINDS_ZH})(?:\\s*{_NUMBERS})?)(?:\\s*[.:：]|\\s|$)', 1)) AS named FROM h)
    SELECT id, CASE WHEN logical THEN trim(kind || ' ' || number) WHEN is_heading THEN NULL WHEN custom <> '' THEN custom WHEN numeric <> '' THEN numeric ELSE nullif(named, '') END AS label,
    CASE WHEN logical THEN 'heading' WHEN is_heading THEN NULL WHEN custom <> '' THEN 'custom' WHEN numeric <> '' THEN 'numeric' WHEN named <> '' THEN 'named' END AS family FROM f""")
def unit_labels(spark, sf_dir):
    """The label at each sample unit's start and its family."""
    return UNITS.frame(spark).select("id", X.unit_label(F.col("text")).alias("u")).select("id", "u.label", "u.family")


@query("""WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS s, turn, length(coalesce(text, '')) AS n FROM conversations),
    r AS (SELECT conv_id, s, turn, 0 AS batch, n AS filled FROM t WHERE s = 1 UNION ALL
    SELECT t.conv_id, t.s, t.turn, CASE WHEN filled > 0 AND filled + t.n > 200 THEN batch + 1 ELSE batch END, CASE WHEN filled > 0 AND filled + t.n > 200 THEN t.n ELSE filled + t.n END FROM r JOIN t ON t.conv_id = r.conv_id AND t.s = r.s + 1)
    SELECT conv_id, turn, batch FROM r""")
def unit_batches(spark, sf_dir):
    """Turns filled into batches of 200 characters in order; a longer turn stands alone."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return S.batched(c, "conv_id", "turn", "n", 200)


@query("""WITH t AS (SELECT doc_id, string_split(replace(text, '$$', '  '), '$') AS p FROM documents WHERE length(text) > 400), pc AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS piece FROM t),
    b AS (SELECT *, coalesce(sum(length(piece) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pc),
    s AS (SELECT doc_id, i, before, len(q) AS n, generate_subscripts(q, 1) AS k, unnest(q) AS sentence FROM (SELECT *, string_split(regexp_replace(piece, '([.!?;])(\\s)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS q FROM b WHERE i % 2 = 1)),
    c AS (SELECT doc_id, k, n, (before + sum(length(sentence)) OVER (PARTITION BY doc_id, i ORDER BY k ROWS UNBOUNDED PRECEDING))::BIGINT AS p FROM s)
    SELECT doc_id, count(*) AS places, min(p) AS first_place, max(p) AS last_place FROM c WHERE k < n GROUP BY ALL""")
def sentence_places(spark, sf_dir):
    """Where prose may be cut: behind .!?; before white space, outside inline math."""
    d = table(spark, sf_dir, "documents").where(F.length("text") > 400)
    return S.safe_places(d, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("places"), F.min("place").alias("first_place"), F.max("place").alias("last_place"))


# References resolved to earlier statements.

NODES = Sample("nodes_", {"doc_id": "int", "pos": "int", "type": "string", "number": "string", "tex_label": "string", "title": "string", "aliases": "array<string>"}, [
    (1, 0, "定义", "1", "def:a", "Groups and rings", ["定义1", "Definition1"]), (1, 1, "定理", "2", None, "Main theorem", ["定理2", "Theorem2"]), (1, 2, "推论", "3", "cor", None, ["推论3"]), (1, 3, "定理", "2", None, "abc", ["定理2"]),
    (1, 4, None, None, "x", "Groups and rings", []), (1, 5, "定理", "9", None, "Late one here", ["定理9"]), (2, 0, "公理", "1", "a", "Only axiom", ["公理1"]), (2, 1, "定理", "4", "b", None, ["定理4"]),
])
HITS = Sample("hits_", {"doc_id": "int", "pos": "int", "hit": "int", "kind": "string", "type": "string", "number": "string", "surface": "string"}, [
    (1, 2, 0, "explicit", "定理", "2", "定理 2"), (1, 2, 1, "explicit", "定义", "1", "Definition 1"), (1, 4, 0, "explicit", "定理", "2", "定理2"), (1, 3, 0, "tex", "cref", "cor", "\\cref{cor}"), (1, 3, 1, "tex", "cref", "zz", "\\cref{zz}"),
    (1, 2, 2, "explicit", "定理", "9", "定理 9"), (1, 0, 0, "explicit", "定理", "2", "定理 2"), (2, 1, 0, "explicit", "公理", "1", "公理 1"), (2, 1, 1, "tex", "ref", "b", "\\ref{b}"), (1, 5, 0, "explicit", "命题", "8", "命题 8"), (1, 4, 1, "explicit", None, None, "推论 3"),
])
_INDEX = """ix AS (SELECT doc_id, 1 AS tier, tex_label AS key, pos FROM nodes_ WHERE tex_label IS NOT NULL UNION ALL SELECT doc_id, 2, type || chr(0) || number, pos FROM nodes_ WHERE type IS NOT NULL AND number IS NOT NULL
    UNION ALL SELECT doc_id, 3, unnest(list_distinct(aliases)), pos FROM nodes_ UNION ALL SELECT doc_id, 4, trim(title), pos FROM nodes_ WHERE length(trim(title)) >= 4)"""
_RESOLVED = f"""{NODES.sql}, {HITS.sql}, {_INDEX},
    ask AS (SELECT doc_id, pos, hit, 1 AS tier, number AS key FROM hits_ WHERE kind = 'tex' UNION ALL SELECT doc_id, pos, hit, 2, concat_ws(chr(0), type, number) FROM hits_ WHERE kind <> 'tex' UNION ALL SELECT doc_id, pos, hit, 3, regexp_replace(surface, '\\s+', '', 'g') FROM hits_ WHERE kind <> 'tex'),
    fo AS (SELECT a.doc_id, a.pos, a.hit, a.tier, i.pos AS pl FROM ask a JOIN ix i USING (doc_id, tier, key)),
    pr AS (SELECT doc_id, pos, hit, count(DISTINCT pl) AS n, count(*) FILTER (pl > pos) AS ahead, min(tier * 1000 - pl) FILTER (pl < pos) AS best FROM fo GROUP BY ALL),
    re AS (SELECT h.*, CASE WHEN best IS NOT NULL THEN ceil(best / 1000)::INT * 1000 - best END AS target, CASE WHEN best IS NOT NULL THEN NULL WHEN n IS NULL THEN 'no_candidate' WHEN n = 1 AND ahead >= 1 THEN 'only_forward_candidate' ELSE 'duplicate_label_or_alias' END AS reason
           FROM hits_ h LEFT JOIN pr USING (doc_id, pos, hit))"""


@query(f"WITH {NODES.sql}, {_INDEX} SELECT doc_id, tier, replace(key, chr(0), '|') AS key, min(pos) AS first_pos, count(DISTINCT pos) AS places FROM ix GROUP BY ALL")
def label_index(spark, sf_dir):
    """The first place and the number of places of every name of a statement."""
    i = resolve.label_index(NODES.frame(spark))
    return i.groupBy("doc_id", "tier", F.replace("key", F.lit("\0"), F.lit("|")).alias("key")).agg(F.min("pos").alias("first_pos"), F.count_distinct("pos").alias("places"))


@query(f"WITH {_RESOLVED} SELECT doc_id, pos, hit, target, reason FROM re")
def resolved_references(spark, sf_dir):
    """Each reference with the nearest earlier statement that it names, or why there is none."""
    return resolve.resolved(HITS.frame(spark), resolve.label_index(NODES.frame(spark))).select("doc_id", "pos", "hit", "target", "reason")


@query(f"WITH {_RESOLVED}, o AS (SELECT doc_id, key, min(pos) AS pl FROM ix WHERE tier = 2 GROUP BY ALL HAVING count(*) = 1) SELECT r.doc_id, r.pos, r.hit, o.pl AS target FROM re r JOIN o ON o.doc_id = r.doc_id AND o.key = concat_ws(chr(0), r.type, r.number) WHERE r.target IS NULL AND o.pl > r.pos")
def forward_repairs(spark, sf_dir):
    """Unresolved references whose only namesake lies ahead."""
    index = resolve.label_index(NODES.frame(spark))
    return resolve.forward_repairs(resolve.resolved(HITS.frame(spark), index).where("target is null"), index).select("doc_id", "pos", "hit", "target")


@query(f"WITH {_RESOLVED} SELECT DISTINCT r.doc_id, r.pos AS dependent, r.target AS support, CASE WHEN lower(n.type) IN ('定义', '公理', 'definition', 'axiom') THEN 'definition' ELSE 'logic' END AS relation FROM re r JOIN nodes_ n ON n.doc_id = r.doc_id AND n.pos = r.target WHERE r.target <> r.pos")
def explicit_edges(spark, sf_dir):
    """Edges from resolved references."""
    nodes = NODES.frame(spark)
    return resolve.explicit_edges(resolve.resolved(HITS.frame(spark), resolve.label_index(nodes)), nodes)


@query(f"WITH {_RESOLVED} SELECT doc_id, count(*) FILTER (target IS NULL) AS unresolved, count(*) FILTER (reason = 'no_candidate') AS no_candidate, count(*) FILTER (reason = 'only_forward_candidate') AS only_forward, count(*) FILTER (reason = 'duplicate_label_or_alias') AS ambiguous, count(*) AS hits FROM re GROUP BY ALL")
def reference_quality(spark, sf_dir):
    """Unresolved references by reason (the quality counters of reference extraction)."""
    return resolve.reference_quality(resolve.resolved(HITS.frame(spark), resolve.label_index(NODES.frame(spark))))


@query(f"WITH {NODES.sql} SELECT doc_id, key, list(pos ORDER BY pos) AS candidates FROM (SELECT doc_id, pos, type || chr(0) || number AS key FROM nodes_ WHERE type IS NOT NULL AND number IS NOT NULL UNION ALL SELECT doc_id, pos, unnest(aliases) FROM nodes_) GROUP BY ALL")
def repair_candidates(spark, sf_dir):
    """Every place of each number and alias, repeats included."""
    return resolve.candidate_places(NODES.frame(spark))


# Types and sorts of nodes with every kind of value.

TYPED = Sample("typed", {"id": "string", "kind": "string", "label": "string", "title": "string", "content": "string"}, [
    ("10", "定理", "定理 2", "Mean value", "x = 1"), ("2", " Definition ", "定义 1", "Sets", "a set"), ("b", "LEMMA", None, "mean value", "see x"), ("a", "例", "例 1", "Other", None), ("3", "Exercise", "7", "MEAN VALUE", "compute"), ("x", None, None, None, None),
    ("4", "公理", "1", "Choice", "every set"), ("5", "remark", "", "Note", "text"), ("11", "claim", "C", "Sets", "x_1 \\le y"),
])
_REL = ", ".join(f"'{t}'" for t in ("性质", "定理", "引理", "推论", "property", "theorem", "lemma", "proposition", "corollary", "claim", "conjecture", "problem", "observation", "fact"))
_NORM = "CASE WHEN regexp_matches(trim(kind), '^[\\x00-\\x7F]*$') THEN lower(trim(kind)) ELSE trim(kind) END"


@query(f"WITH {TYPED.sql} SELECT id, coalesce({_NORM}, '') AS normal, coalesce({_NORM} IN ({_REL}), false) AS relation, coalesce({_NORM} IN ('定义', '公理', 'definition', 'axiom'), false) AS definition FROM typed")
def type_predicates(spark, sf_dir):
    """The type predicates over every kind of type name."""
    t = F.col("kind")
    return TYPED.frame(spark).select("id", F.coalesce(K.normal_type(t), F.lit("")).alias("normal"), F.coalesce(K.is_relation(t), F.lit(False)).alias("relation"), F.coalesce(K.is_definition(t), F.lit(False)).alias("definition"))


@query(f"WITH {TYPED.sql} SELECT id, row_number() OVER (ORDER BY try_cast(id AS BIGINT) IS NULL, try_cast(id AS BIGINT), id) - 1 AS place FROM typed")
def merged_order(spark, sf_dir):
    """Nodes by key: whole numbers first, by value, then the others."""
    return R.order_by_key(TYPED.frame(spark), "id").select("id", F.col("place").cast("long").alias("place"))


@query(f"""WITH {TYPED.sql}, u AS (SELECT id, title, content FROM typed UNION ALL SELECT doc_id::VARCHAR, source, text FROM documents)
    SELECT id FROM u WHERE contains(lower(coalesce(title, '')), 'mean') OR contains(lower(coalesce(content, '')), 'mean') ORDER BY id LIMIT 30""")
def node_search(spark, sf_dir):
    """The first 30 nodes and documents whose title or text has a word."""
    rows = TYPED.frame(spark).select("id", "title", "content").unionByName(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.col("text").alias("content")))
    return R.found_text(rows, ["title", "content"], "mean").select("id")


EDGES = Sample("edges_", {"src": "string", "dst": "string", "label": "string", "reason": "string"}, [
    ("10", "2", "uses", "uses definition of sets"), ("b", "10", "logic", "特例 of it"), ("b", "zz", "logic", "derive"), ("3", "3", "self", "iff"), ("11", "4", "logic", "a counterexample"), ("a", "10", "x", "举例"), ("4", "2", "y", None), ("yy", "2", "q", "推广"), ("5", "b", "w", "prerequisite"),
    ("2", "5", "k", "apply"), ("10", "4", "uses", "nothing said"),
])
_KIND_CASES = " ".join(f"WHEN regexp_matches(h, '{p}', 'i') THEN '{k}'" for p, k in G.EDGE_KINDS)


@query(f"WITH {EDGES.sql} SELECT src, dst, CASE {_KIND_CASES} ELSE 'related' END AS kind FROM (SELECT src, dst, label || ' ' || coalesce(reason, '') AS h FROM edges_)")
def edge_kinds(spark, sf_dir):
    """The taxonomy of edges over every kind of reason."""
    return EDGES.frame(spark).select("src", "dst", G.edge_kind(F.col("label"), F.col("reason")).alias("kind"))


@query(f"WITH {TYPED.sql}, {EDGES.sql} SELECT e.src, e.dst, e.label FROM edges_ e JOIN typed a ON a.id = e.src JOIN typed b ON b.id = e.dst WHERE {_NORM.replace('kind', 'a.kind')} IN ({_REL}) AND {_NORM.replace('kind', 'b.kind')} IN ({_REL})")
def visible_edges(spark, sf_dir):
    """Edges between visible nodes: those of relation types."""
    return R.visible(TYPED.frame(spark).where(K.is_relation(F.col("kind"))), EDGES.frame(spark)).select("src", "dst", "label")


@query(f"WITH {EDGES.sql} SELECT src, dst, label, 'out' AS direction FROM edges_ WHERE src = '10' UNION ALL SELECT src, dst, label, 'in' FROM edges_ WHERE dst = '10'")
def incident_edges(spark, sf_dir):
    """The edges of one node, in and out."""
    return G.incident(EDGES.frame(spark), F.lit("10")).select("src", "dst", "label", "direction")


@query(f"""WITH {TYPED.sql}, {EDGES.sql} SELECT src, dst, label FROM edges_ UNION ALL SELECT 'a', 'b', 'new'""")
def relation_upsert(spark, sf_dir):
    """Relations added: one is new, one exists, two lack an end."""
    rows = spark.createDataFrame([("a", "b", "new"), ("10", "2", "uses"), ("a", "gone", "new"), ("gone", "a", "new"), ("a", "b", "new")], "src string, dst string, label string")
    return G.upsert_relations(TYPED.frame(spark), EDGES.frame(spark), rows).select("src", "dst", "label")


@query(f"WITH {EDGES.sql} SELECT src, dst, label, reason FROM edges_ WHERE NOT (src = '10' AND label = 'uses')")
def relation_delete(spark, sf_dir):
    """Relations without those deleted by ends and label."""
    gone = spark.createDataFrame([("10", "2", "uses"), ("10", "4", "uses"), ("10", "2", "other")], "src string, dst string, label string")
    return G.delete_relations(EDGES.frame(spark), gone).select("src", "dst", "label", "reason")


@query(f"WITH {TYPED.sql} SELECT id, CASE WHEN id = '2' THEN 'renamed' WHEN id = 'x' THEN NULL ELSE title END AS title, CASE WHEN id IN ('2', 'x') THEN 'set' END AS state, kind FROM typed")
def node_property_update(spark, sf_dir):
    """Nodes with two of their properties changed or added by id; other properties and nodes are kept."""
    rows = spark.createDataFrame([("2", "renamed", "set"), ("x", None, "set"), ("missing", "no", "no")], "id string, title string, state string")
    return G.updated(TYPED.frame(spark), rows, ["id"]).select("id", "title", "state", "kind")


@query(f"WITH {EDGES.sql} SELECT src, dst, CASE WHEN src = 'b' AND dst = '10' THEN 'changed' ELSE reason END AS reason, label FROM edges_")
def relation_property_update(spark, sf_dir):
    """A relation with its reason changed."""
    rows = spark.createDataFrame([("b", "10", "logic", "changed")], "src string, dst string, label string, reason string")
    return G.updated(EDGES.frame(spark), rows, ["src", "dst", "label"]).select("src", "dst", "reason", "label")


@query(f"WITH {TYPED.sql} SELECT id, kind, title FROM typed UNION ALL SELECT 'n1', 'claim', 'New'")
def node_merge(spark, sf_dir):
    """Nodes merged by all their properties: equal rows are one, rows that differ anywhere are added."""
    nodes = TYPED.frame(spark).select("id", "kind", "title")
    rows = nodes.where("id in ('2', 'x')").unionByName(spark.createDataFrame([("n1", "claim", "New")] * 2, "id string, kind string, title string"))
    return G.merge_nodes(nodes, rows)


@query("SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey = 2 UNION ALL SELECT r_regionkey, r_name FROM region WHERE r_regionkey = 1")
def point_lookups(spark, sf_dir):
    """Nodes by the value of a property, and one by its id."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return G.with_value(n, "region", 2).select("id", "name").unionByName(G.with_value(r, "id", 1).limit(1))


@query(f"WITH {TYPED.sql} SELECT value, row_number() OVER (ORDER BY value NULLS LAST) - 1 AS place FROM (SELECT DISTINCT kind AS value FROM typed WHERE id <> 'a')")
def distinct_with_null(spark, sf_dir):
    """Distinct values of a key in order, null kept, last."""
    return G.distinct_in_order(TYPED.frame(spark).where("id <> 'a'"), "kind").withColumn("place", F.col("place").cast("long"))


@query(f"WITH {TYPED.sql}, {EDGES.sql}, d AS (SELECT *, title || CASE WHEN row_number() OVER (PARTITION BY title ORDER BY id) > 1 THEN '#' || row_number() OVER (PARTITION BY title ORDER BY id) ELSE '' END AS unique_id FROM typed WHERE title IS NOT NULL) SELECT a.unique_id AS src, b.unique_id AS dst, e.label FROM edges_ e JOIN typed s ON s.id = e.src JOIN typed t ON t.id = e.dst JOIN d a ON a.title = s.title JOIN d b ON b.title = t.title")
def title_graph_view(spark, sf_dir):
    """The graph by title: equal titles numbered, an edge between titles becoming one between all their holders."""
    nodes, edges = TYPED.frame(spark), EDGES.frame(spark)
    by_title = edges.join(nodes.select(F.col("id").alias("src"), F.col("title").alias("src_title")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("title").alias("dst_title")), "dst")
    return G.title_view(nodes, by_title.select("src_title", "dst_title", "label"))[1]


# Edges of every order: between customers by number, relations and reasons by what the order is.
_ORDER_EDGES = """oe AS (SELECT 'c' || (o_custkey % 60) AS src, ' c' || (o_orderkey * 7 % 61) AS dst, CASE o_orderkey % 5 WHEN 0 THEN '逻辑依赖' WHEN 1 THEN ' 定义依赖' WHEN 2 THEN '逻辑依赖 ' WHEN 3 THEN '定义依赖' ELSE '相关' END AS relation,
    CASE o_orderstatus WHEN 'F' THEN '正则匹配：' || o_orderpriority WHEN 'O' THEN ' it  Does not' || CASE WHEN o_orderkey % 3 = 0 THEN ' depend on it' ELSE '' END WHEN 'P' THEN repeat('x', (o_orderkey % 150)::INT) END AS reason, o_orderkey AS pos FROM orders)"""
_PRIORITY = "(CASE WHEN starts_with(trim(coalesce(reason, '')), '正则匹配：') THEN 4000 ELSE 0 END + CASE trim(relation) WHEN '定义依赖' THEN 2000 WHEN '逻辑依赖' THEN 1000 ELSE 0 END + least(length(trim(coalesce(reason, ''))), 120)) / 1000"


def _order_edges(spark, sf_dir):
    k = F.col("o_orderkey")
    relation = F.element_at(F.array(*map(F.lit, ("逻辑依赖", " 定义依赖", "逻辑依赖 ", "定义依赖", "相关"))), (k % 5 + 1).cast("int"))
    denial = F.concat(F.lit(" it  Does not"), F.when(k % 3 == 0, " depend on it").otherwise(""))
    reason = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("正则匹配："), "o_orderpriority")).when(F.col("o_orderstatus") == "O", denial).when(F.col("o_orderstatus") == "P", F.repeat(F.lit("x"), (k % 150).cast("int")))
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), (F.col("o_custkey") % 60).cast("string")).alias("src"), F.concat(F.lit(" c"), (k * 7 % 61).cast("string")).alias("dst"), relation.alias("relation"), reason.alias("reason"), k.alias("pos"))


@query(f"WITH {_ORDER_EDGES} SELECT pos, round({_PRIORITY}, 6) AS priority FROM oe")
def edge_priorities(spark, sf_dir):
    """The priority of each order's edge by its reason and relation."""
    return _order_edges(spark, sf_dir).select("pos", F.round(G.edge_priority(F.col("relation"), F.col("reason")), 6).alias("priority"))


@query(f"""WITH {_ORDER_EDGES}, g AS (SELECT trim(src) AS src, trim(dst) AS dst, trim(relation) AS relation, trim(coalesce(reason, '')) AS reason, pos, {_PRIORITY} AS priority FROM oe
        WHERE trim(src) <> trim(dst) AND trim(relation) IN ('逻辑依赖', '定义依赖') AND NOT contains(lower(regexp_replace(trim(coalesce(reason, '')), '\\s+', ' ', 'g')), 'does not depend')),
    b AS (SELECT *, min(pos) OVER (PARTITION BY src, dst) AS first FROM g QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY priority DESC, pos) = 1),
    o AS (SELECT 'c' || c_custkey AS id, c_custkey * 37 % 101 AS place FROM customer WHERE c_custkey < 50),
    p AS (SELECT b.*, coalesce(f.place, -1) - coalesce(t.place, -1) AS later FROM b LEFT JOIN o f ON f.id = src LEFT JOIN o t ON t.id = dst)
    SELECT a.src, a.dst, a.relation, a.reason, round(a.priority, 6) AS priority, a.pos FROM p a LEFT JOIN p z ON z.src = a.dst AND z.dst = a.src
    WHERE z.src IS NULL OR a.priority > z.priority OR (a.priority = z.priority AND (a.later > z.later OR (a.later = z.later AND a.first < z.first)))""")
def filtered_edges(spark, sf_dir):
    """The edges of orders that stay: known, not denied, one for each pair of customers in either direction."""
    order = table(spark, sf_dir, "customer").where("c_custkey < 50").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), (F.col("c_custkey") * 37 % 101).alias("pos"))
    return G.filter_edges(_order_edges(spark, sf_dir), order).withColumn("priority", F.round("priority", 6))


CYCLE = Sample("cyc", {"src": "int", "dst": "int"}, [(0, 1), (1, 2), (2, 3), (0, 3), (4, 5), (5, 6), (6, 5), (6, 7), (8, 8), (3, 9), (9, 10)])


@query(f"WITH {CYCLE.sql}, n AS (SELECT unnest(range(0, 12))::INT AS id), want AS (SELECT * FROM (VALUES (0, 0), (1, 1), (2, 2), (3, 3), (4, 0), (8, 0), (9, 4), (10, 5), (11, 0)) v(id, depth)) SELECT id, coalesce(depth, 6) AS depth, depth IS NULL AS cyclic FROM n LEFT JOIN want USING (id)")
def longest_depth_cycles(spark, sf_dir):
    """Longest paths in a graph with a cycle, a node behind it, a self-loop and a lone node."""
    return G.longest_depths(spark.range(12).select(F.col("id").cast("int")), CYCLE.frame(spark))


# Secrets, hashes and titles.

SECRETS = Sample("secrets", {"id": "int", "text": "string"}, [(1, "api_key=abc&x=1"), (2, "Bearer a.b-c_d~e+f/== rest"), (3, "password : hunter2, token=zz;ok"), (4, None), (5, "plain"), (6, "bearer xyz API-KEY=q secret=s")])


@query(f"""WITH {SECRETS.sql} SELECT id, regexp_replace(regexp_replace(text, '(?i)\\bbearer\\s+[A-Za-z0-9._~+/=-]+', 'Bearer [redacted]', 'g'), '(?i)\\b(api[_-]?key|password|secret|token)(\\s*[=:]\\s*)[^\\s&,;]+', '\\1\\2[redacted]', 'g') AS text FROM secrets""")
def redacted_texts(spark, sf_dir):
    """Texts with bearer tokens and key=value secrets masked."""
    return SECRETS.frame(spark).select("id", T.redact_text(F.col("text")).alias("text"))


@query("SELECT event_id, sha256('{' || string_agg('\"' || key || '\":' || value, ',' ORDER BY key) || '}') AS hash FROM (SELECT event_id, key, json_extract(props, '$.' || key)::VARCHAR AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)) GROUP BY ALL")
def content_hashes(spark, sf_dir):
    """SHA-256 of each event's property object with its keys in order and no blanks."""
    return table(spark, sf_dir, "events").select("event_id", T.json_hash(F.col("props")).alias("hash"))


@query(f"WITH {TYPED.sql} SELECT id, trim(regexp_replace(coalesce(nullif(trim(content), ''), nullif(trim(title), ''), nullif(trim(label), ''), ''), '\\s+', ' ', 'g')) AS content FROM typed")
def node_contents(spark, sf_dir):
    """The first filled of content, title and label, white space folded."""
    return TYPED.frame(spark).select("id", T.folded(T.first_filled("content", "title", "label")).alias("content"))


@query("""WITH w AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations),
    c AS (SELECT *, CASE WHEN length(t) <= 1200 THEN t ELSE rtrim(substr(t, 1, 1180)) || ' ...[truncated]' END AS short FROM w)
    SELECT conv_id, turn, (s - 1) // 8 AS batch, lag(short) OVER (PARTITION BY conv_id ORDER BY turn) AS previous, lead(short) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM c""")
def cleaning_batches(spark, sf_dir):
    """Turns in batches of eight, each with a summary of the turns beside it: white space folded, beyond 1,200 characters cut and marked."""
    c = table(spark, sf_dir, "conversations")
    return S.cleaning_batches(c, "conv_id", "turn", "text", 8).select("conv_id", "turn", "batch", "previous", "next")


@query(f"""WITH {UNITS.sql}, t AS (SELECT id, coalesce(text, '') AS t FROM units_) SELECT id, array_to_string(list_filter([CASE WHEN regexp_matches(t, '!\\[[^\\]]*\\]\\([^)]+\\)') THEN 'image' END, CASE WHEN contains(t, '??') THEN 'unknown_reference' END,
    CASE WHEN len(regexp_extract_all(t, '(?m)^\\s*#{{1,6}}\\s+\\S')) > 1 THEN 'multiple_headings' END, CASE WHEN length(t) > 2500 THEN 'too_long' END], lambda x: x IS NOT NULL), ',') AS flags FROM t
    UNION ALL SELECT doc_id::INT + 1000, array_to_string(list_filter([CASE WHEN regexp_matches(text, '!\\[[^\\]]*\\]\\([^)]+\\)') THEN 'image' END, CASE WHEN contains(text, '??') THEN 'unknown_reference' END,
    CASE WHEN len(regexp_extract_all(text, '(?m)^\\s*#{{1,6}}\\s+\\S')) > 1 THEN 'multiple_headings' END, CASE WHEN length(text) > 2500 THEN 'too_long' END], lambda x: x IS NOT NULL), ',') FROM documents""")
def block_quality(spark, sf_dir):
    """Quality flags of sample blocks and documents: images, unknown references, several headings, great length."""
    rows = UNITS.frame(spark).unionByName(table(spark, sf_dir, "documents").select((F.col("doc_id").cast("int") + 1000).alias("id"), "text"))
    return rows.select("id", F.array_join(S.quality_flags(F.col("text")), ",").alias("flags"))


@query(f"WITH {UNITS.sql} SELECT flag, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN regexp_matches(text, '!\\[[^\\]]*\\]\\([^)]+\\)') THEN 'image' END, CASE WHEN contains(text, '??') THEN 'unknown_reference' END, CASE WHEN len(regexp_extract_all(text, '(?m)^\\s*#{{1,6}}\\s+\\S')) > 1 THEN 'multiple_headings' END, CASE WHEN length(text) > 2500 THEN 'too_long' END], lambda x: x IS NOT NULL)) AS flag FROM (SELECT text FROM units_ UNION ALL SELECT text FROM documents)) GROUP BY ALL")
def quality_histogram(spark, sf_dir):
    """How often each quality flag occurs."""
    rows = UNITS.frame(spark).select("text").unionByName(table(spark, sf_dir, "documents").select("text"))
    flags = rows.select(F.explode(S.quality_flags(F.col("text"))).alias("flag"))
    return flags.groupBy("flag").agg(F.count("*").alias("n"))
