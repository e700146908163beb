"""Queries over the checks and decisions around extraction and relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.functions import references as X
from stemma.operators import coverage as C
from stemma.operators import review as W
from stemma.queries_text import _HEAD, EDGES, TYPED, UNITS
from stemma.registry import Sample, query, table

_MATH = "[$=<>∀∃∈≤≥→⇒]|\\\\[A-Za-z]+|\\d\\s*[+*/^-]\\s*\\d"


@query(f"SELECT doc_id, regexp_matches(coalesce(text, ''), '{_MATH}') AS math FROM documents")
def math_signals(spark, sf_dir):
    """Whether each document shows mathematics."""
    return table(spark, sf_dir, "documents").select("doc_id", W.math_signal(F.col("text")).alias("math"))


@query("""WITH h AS (SELECT o_custkey AS id, count(*) AS nodes, sum(o_orderkey % 7)::BIGINT AS edges, sum(o_totalprice)::BIGINT AS json_bytes FROM orders GROUP BY ALL)
    SELECT id, 'nodes_over_limit' AS problem FROM h WHERE nodes > 12 UNION ALL SELECT id, 'edges_over_limit' FROM h WHERE edges > 40 UNION ALL SELECT id, 'json_bytes_over_limit' FROM h WHERE json_bytes > 3000000""")
def capacity_problems(spark, sf_dir):
    """Customers whose orders pass a limit."""
    h = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("nodes"), F.sum(F.col("o_orderkey") % 7).alias("edges"), F.sum("o_totalprice").alias("_b")).withColumn("json_bytes", F.round("_b").cast("long"))
    return W.capacity_problems(h, {"nodes": 12, "edges": 40, "json_bytes": 3_000_000})


IDENTITIES = Sample("idents", {"id": "int", "label": "string", "kind": "string", "text": "string"}, [
    (1, "Theorem 2-1", "Theorem", "# Theorem 2-1\n Let  x，y"), (2, "定理 3.2", "定理", "设 x。"), (3, "Lemma", "lemma", None), (4, "Main  Result", None, "## A b\nC"), (5, None, None, ""), (6, "Def 4.a", " definition ", "  ### h\n（x）！"),
])


_ENGLISH = "CASE " + " ".join(f"WHEN {{0}} = '{zh}' THEN '{en}'" for zh, en in C.ENGLISH.items()) + " WHEN {0} IN (" + ", ".join(f"'{w.lower()}'" for w in C.TYPE_WORDS if w.isascii()) + ") THEN {0} ELSE '' END"


@query(f"""WITH {IDENTITIES.sql}, a AS (FROM idents UNION ALL SELECT p_partkey::INT + 1000, CASE p_partkey % 4 WHEN 0 THEN '## Theorem ' || p_size || '-' || p_partkey % 7 || '.' WHEN 1 THEN 'Lemma ' || p_size || '.b' WHEN 2 THEN p_name || ' : ' ELSE p_brand END,
        CASE p_partkey % 3 WHEN 0 THEN '引理' WHEN 1 THEN p_type END, p_name || chr(10) || ' # ' || p_type || chr(10) || '（' || p_brand || '）\\t end' FROM part),
    n AS (SELECT *, rtrim(regexp_replace(regexp_replace(lower(trim(coalesce(label, ''))), '^\\s*#{{1,6}}\\s*', ''), '\\s+', ' ', 'g'), ' .:;,：；，。') AS plain, lower(trim(coalesce(kind, ''))) AS k FROM a),
    m AS (SELECT *, regexp_extract(plain, '\\d+(?:[.\\-][A-Za-z0-9]+)*') AS number, {_ENGLISH.format("k")} AS own FROM n),
    t AS (SELECT *, CASE WHEN own = '' AND number <> '' THEN {_ENGLISH.format("trim(string_split(plain, number)[1])")} ELSE own END AS named FROM m)
    SELECT id, CASE WHEN named = '' THEN 'label:' || plain WHEN number <> '' THEN named || ':' || replace(number, '-', '.') ELSE named || ':unnumbered' END AS identity,
    regexp_replace(regexp_replace(translate(regexp_replace(coalesce(text, ''), '\\\\t(\\s|[$\\\\]|$)', '\\1', 'g'), '，。；：！？（）', ',.;:!?()'), '(?m)^[ \\t]*#{{1,6}}[ \\t]+[^\\r\\n]*(?:\\r?\\n|$)', ''), '\\s+', '', 'g') AS surface FROM t""")
def label_identities(spark, sf_dir):
    """Identity of labels and surface fingerprint of texts: samples, and every part's."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    size, brand = F.col("p_size").cast("string"), F.col("p_brand")
    label = F.when(k % 4 == 0, F.concat(F.lit("## Theorem "), size, F.lit("-"), (k % 7).cast("string"), F.lit("."))).when(k % 4 == 1, F.concat(F.lit("Lemma "), size, F.lit(".b"))).when(k % 4 == 2, F.concat("p_name", F.lit(" : "))).otherwise(brand)
    kind = F.when(k % 3 == 0, "引理").when(k % 3 == 1, F.col("p_type"))
    text = F.concat("p_name", F.lit("\n # "), "p_type", F.lit("\n（"), brand, F.lit("）\\t end"))
    rows = IDENTITIES.frame(spark).unionByName(p.select((k.cast("int") + 1000).alias("id"), label.alias("label"), kind.alias("kind"), text.alias("text")))
    return rows.select("id", C.label_identity(F.col("label"), F.col("kind")).alias("identity"), C.surface_fingerprint(F.col("text")).alias("surface"))


CANDIDATES = Sample("cand_", {"block": "int", "start": "int", "identity": "string"}, [(1, 0, "theorem:1"), (2, 50, "lemma:2"), (3, 90, "lemma:3"), (4, 120, "definition:1"), (5, 150, "claim:unnumbered")])
COVERED = Sample("covered_", {"block": "int", "start": "int", "identity": "string"}, [(1, None, None), (None, 50, "lemma:2"), (None, 90, "lemma:9"), (9, 150, "other:1"), (None, None, "claim:unnumbered")])


@query(f"WITH {CANDIDATES.sql}, {COVERED.sql} SELECT block, start, identity FROM cand_ c WHERE NOT EXISTS (FROM covered_ v WHERE v.block = c.block) AND NOT EXISTS (FROM covered_ v WHERE v.start = c.start AND v.identity = c.identity)")
def missing_candidates(spark, sf_dir):
    """Candidates that no statement covers, by block or by place and identity."""
    return W.missing_candidates(CANDIDATES.frame(spark), COVERED.frame(spark)).select("block", "start", "identity")


_RULE = "CASE WHEN logical THEN 'block_start' WHEN is_heading THEN 'context' WHEN regexp_matches(trim(t), '(?i)^(proof|证明|证)([^\\pL\\pN_]|$)') THEN 'support' WHEN id = 0 THEN 'block_start' ELSE 'continuation' END"


@query(f"""WITH {UNITS.sql}, {_HEAD}, ro AS (SELECT id, logical, is_heading, {_RULE} AS rule, CASE id % 4 WHEN 0 THEN 'support' WHEN 1 THEN 'nonsense' WHEN 2 THEN 'continuation' END AS model FROM h)
    SELECT id, rule, CASE WHEN logical THEN 'block_start' WHEN is_heading THEN 'context' WHEN model IN ('block_start', 'context', 'support', 'continuation') THEN model ELSE rule END AS role FROM ro""")
def unit_roles(spark, sf_dir):
    """The role of sample units by rules, and with a model's answers, which headings overrule."""
    u = UNITS.frame(spark)
    first = F.col("id") == 0
    h, rule = X.heading(F.col("text"))["kind"], W.rule_role(X.heading(F.col("text"))["kind"], X.unit_flags(F.col("text"), first), first)
    model = F.when(F.col("id") % 4 == 0, "support").when(F.col("id") % 4 == 1, "nonsense").when(F.col("id") % 4 == 2, "continuation")
    return u.select("id", rule.alias("rule"), W.final_role(h, model, rule).alias("role"))


@query("SELECT conv_id AS doc_id, turn AS pos, CASE WHEN (turn // 3) % 2 = 0 THEN 'even' ELSE 'odd' END AS role, 'c' || (turn // 3) AS evidence FROM conversations")
def chunk_cores(spark, sf_dir):
    """Answers of overlapping chunks: each turn from the chunk in whose core it lies."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("pos"))
    own = F.floor(F.col("pos") / 3).cast("int")
    chunks = c.select("doc_id", own.alias("chunk")).distinct().withColumns({"core_start": F.col("chunk") * 3, "core_end": F.col("chunk") * 3 + 3})
    answers = c.select("doc_id", "pos", F.explode(F.array(own - 1, own, own + 1)).alias("chunk")).where("chunk >= 0")
    said = F.concat(F.lit("c"), F.col("chunk").cast("string"))
    answers = answers.select("doc_id", "pos", "chunk", F.when(F.col("chunk") % 2 == 0, "even").otherwise("odd").alias("role"), F.array(said, said).alias("evidence"))
    return W.merged_chunks(chunks, answers).select("doc_id", "pos", "role", F.array_join("evidence", ",").alias("evidence"))


MEMBERS = Sample("members_", {"block": "int", "node": "string", "label": "string", "trusted_label": "string", "anchored": "boolean"}, [
    (1, "a", None, "T1", False), (2, "b", "T1", "T1", False), (2, "c", "T2", "T1", True), (3, "d", "T1", "T1", False), (3, "e", "T1", "T1", True), (4, "f", None, None, False), (4, "g", None, None, False), (5, "h", "x", None, True), (5, "i", "y", None, True),
])


@query(f"""WITH {MEMBERS.sql}, p AS (SELECT block, count(*) AS n, min(node) AS node, count(*) FILTER (label = trusted_label) AS l, min(node) FILTER (label = trusted_label) AS ln, count(*) FILTER (anchored) AS a, min(node) FILTER (anchored) AS an FROM members_ GROUP BY ALL)
    SELECT block, CASE WHEN n = 1 THEN node WHEN l = 1 THEN ln WHEN a = 1 THEN an END AS node, CASE WHEN n = 1 THEN 'single' WHEN l = 1 THEN 'label' WHEN a = 1 THEN 'anchor' ELSE 'ambiguous' END AS how FROM p""")
def chosen_parents(spark, sf_dir):
    """The parent of each group of nodes: single, by label, by anchor or ambiguous."""
    return W.chosen_parents(MEMBERS.frame(spark))


ENTRIES = Sample("entries_", {"unit": "int", "key": "string", "sorts": "array<string>"}, [
    (1, "P_DIVIDES", ["Int", "Int"]), (2, "P_DIVIDES", ["Int", "Entity"]), (3, "P_DIVIDES", ["Set", "Int"]), (3, "P_IN", ["Entity", "Set"]), (4, "P_IN", ["Int", "Set"]), (4, "P_DIVIDES", ["Int"]), (2, "P_DIVIDES", ["Int", "Entity"]), (5, "P_IN", []),
])


@query(f"""WITH {ENTRIES.sql}, e AS (SELECT DISTINCT * FROM entries_) SELECT a.unit AS dependent, b.unit AS support, array_to_string(list_sort(list(DISTINCT a.key)), ',') AS predicates FROM e a JOIN e b ON a.key = b.key AND b.unit < a.unit AND len(a.sorts) = len(b.sorts)
    AND len(list_filter(range(1, len(a.sorts) + 1), lambda i: NOT (a.sorts[i] = b.sorts[i] OR a.sorts[i] = 'Entity' OR b.sorts[i] = 'Entity'))) = 0 GROUP BY ALL""")
def predicate_matches(spark, sf_dir):
    """Units that share a predicate with fitting sorts."""
    return W.predicate_matches(ENTRIES.frame(spark)).withColumn("predicates", F.array_join("predicates", ","))


@query("""WITH p AS (SELECT a.conv_id, a.turn AS dependent, b.turn AS support, a.role AS label2, a.text AS text2, b.role AS label1, b.text AS text1 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1)
    SELECT (conv_id * 100000 + support) || '-' || (conv_id * 100000 + dependent) AS key, conv_id * 100000 + support AS pos1, conv_id * 100000 + dependent AS pos2, label1, text1, label2, text2, CASE WHEN dependent % 2 = 0 THEN 'yes' END AS answer FROM p""")
def pair_payloads(spark, sf_dir):
    """Pairs of all conversations' neighbours as payloads, with the answers that came back by key."""
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100_000 + F.col("turn")).alias("pos"), F.col("role").alias("label"), "text")
    pairs = c.select(F.col("pos").alias("dependent"), (F.col("pos") - 1).alias("support"))
    rows = W.pair_payloads(pairs, c)
    return W.answers_by_key(rows, rows.where("pos2 % 2 = 0").select("key", F.lit("yes").alias("answer")))


SPAN_NODES = Sample("span_nodes", {"id": "int", "envelope": "string", "own": "string", "keys": "array<string>", "found": "string"}, [
    (1, "0-5", "1-2", ["a"], "9-9"), (2, None, "1-2", ["a"], None), (3, None, None, ["zz", "b", "a"], "9-9"), (4, None, None, ["zz"], "7-8"), (5, None, None, [], None), (6, None, None, ["a", "b"], None),
])
SPAN_BLOCKS = Sample("span_blocks", {"key": "string", "span": "string"}, [("a", "10-20"), ("b", "30-40"), ("c", "50-60")])


@query(f"""WITH {SPAN_NODES.sql}, {SPAN_BLOCKS.sql}, k AS (SELECT id, generate_subscripts(keys, 1) AS i, unnest(keys) AS key FROM span_nodes), f AS (SELECT id, arg_min(span, i) AS block FROM k JOIN span_blocks USING (key) GROUP BY ALL)
    SELECT id, coalesce(envelope, own, block, found) AS span, CASE WHEN envelope IS NOT NULL THEN 'envelope' WHEN own IS NOT NULL THEN 'node' WHEN block IS NOT NULL THEN 'block' WHEN found IS NOT NULL THEN 'text' END AS source FROM span_nodes LEFT JOIN f USING (id)""")
def node_spans(spark, sf_dir):
    """The span of each node: envelope, node, first known block, text."""
    return W.node_spans(SPAN_NODES.frame(spark), SPAN_BLOCKS.frame(spark))


@query("""WITH e AS (SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem) SELECT (SELECT count(*) FROM e WHERE src NOT IN (SELECT s_suppkey FROM supplier) OR dst NOT IN (SELECT s_suppkey FROM supplier)) AS invalid,
    (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM e GROUP BY src, dst)) AS repeated, false AS empty""")
def stage_checks(spark, sf_dir):
    """Items as edges between suppliers: invalid and repeated ones."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return W.stage_checks(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), e)


@query("SELECT * FROM (VALUES ('same', true), ('older', false), ('missing', false), ('more', false), ('invalid', false)) v(name, current)")
def cache_states(spark, sf_dir):
    """Whether kept verdicts are current: all keys, one version, all valid."""
    pairs = spark.range(3).select(F.col("id").alias("key"))
    result = lambda ids, version=2, bad=-1: spark.createDataFrame([(i, version, i != bad) for i in ids], "key long, version int, valid boolean")
    cases = {"same": result([0, 1, 2]), "older": result([0, 1, 2], 1), "missing": result([0, 1]), "more": result([0, 1, 2, 3]), "invalid": result([0, 1, 2], 2, 1)}
    out = None
    for name, rows in cases.items():
        row = W.cache_is_current(pairs, rows, 2).select(F.lit(name).alias("name"), "current")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT conv_id AS doc_id, turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn % 3 = 0 THEN 2147483647 ELSE 100 - turn END, turn) AS place FROM conversations")
def reading_order(spark, sf_dir):
    """Turns by their first block, those without one last."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("id"), F.col("turn").alias("pos"))
    blocks = F.when(F.col("id") % 3 != 0, F.array((200 - F.col("id")).cast("int"), (100 - F.col("id")).cast("int")))
    return W.reading_order(c.withColumn("blocks", blocks)).select("doc_id", "id", "place")


@query("SELECT DISTINCT sha256(l_orderkey::VARCHAR) AS fingerprint, l_orderkey % 3 = 0 AS cached FROM lineitem")
def rerank_cache_hits(spark, sf_dir):
    """Rerank tasks with a valid answer kept, and those to run."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", F.sha2(F.col("l_orderkey").cast("string"), 256).alias("fingerprint"))
    return W.rerank_plan(t, t.where("l_orderkey % 3 < 2").select("fingerprint", (F.col("l_orderkey") % 3 == 0).alias("valid")))


ALIASES = Sample("aliases_", {"id": "int", "alias": "string", "title": "string"}, [
    (1, "定理1", "The \\zeta function and \\Gamma on rings"), (2, "abc", "中值定理 of Lagrange"), (3, "abcd", "a b c"), (4, "群", None), (5, "群论", "one two three four five six seven eight"), (6, "theorem 2", "\\alpha \\alpha beta"), (7, None, ""), (8, "x-1", "In the"),
])
_TYPE_WORDS = ("theorem", "lemma", "definition", "定理", "引理", "定义")


@query(f"""WITH {ALIASES.sql}, a AS (SELECT *, lower(regexp_replace(coalesce(alias, ''), '[^0-9A-Za-z\\x{{4e00}}-\\x{{9fff}}]+', '', 'g')) AS f, regexp_extract_all(coalesce(title, ''), '\\\\[A-Za-z]+') AS tex,
    list_filter(regexp_extract_all(regexp_replace(coalesce(title, ''), '\\\\[A-Za-z]+', ' ', 'g'), '[A-Za-z]{{2,}}|[\\x{{4e00}}-\\x{{9fff}}]{{2,}}'), lambda w: lower(w) NOT IN ('the', 'of', 'and', 'for', 'with', 'on', 'in', 'to', 'by', 'an')) AS w FROM aliases_),
    u AS (SELECT id, f, list_concat(tex, w) AS l FROM a) SELECT id, regexp_matches(f, '^(?:{"|".join(_TYPE_WORDS)})\\d') OR CASE WHEN regexp_matches(f, '^[\\x00-\\x7F]*$') THEN length(f) >= 4 ELSE length(f) >= 2 END AS usable,
    array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:6], ',') AS terms FROM u""")
def alias_and_anchor_terms(spark, sf_dir):
    """Which aliases may name a statement, and the anchor terms of titles."""
    return ALIASES.frame(spark).select("id", W.usable_alias(F.col("alias"), _TYPE_WORDS).alias("usable"), F.array_join(W.anchor_terms(F.col("title")), ",").alias("terms"))


@query("SELECT doc_id, CASE WHEN doc_id * 7 <= length(text) THEN length(substr(text, 1, doc_id * 7)) - length(replace(substr(text, 1, doc_id * 7), chr(10), '')) + 1 END AS line, contains(trim(regexp_replace(text, '\\s+', ' ', 'g')), trim(regexp_replace(substr(text, doc_id + 1, 30), '\\s+', ' ', 'g'))) AND trim(substr(text, doc_id + 1, 30), ' ' || chr(10)) <> '' AS excerpt FROM documents")
def source_lines(spark, sf_dir):
    """The line of a place in each document, and whether a quote of it is an excerpt."""
    quote = F.substr(F.col("text"), (F.col("doc_id") + 1).cast("int"), F.lit(30))
    return table(spark, sf_dir, "documents").select("doc_id", W.line_of(F.col("text"), (F.col("doc_id") * 7).cast("int")).alias("line"), W.is_excerpt(quote, F.col("text")).alias("excerpt"))


@query("SELECT l_orderkey AS doc_id, l_returnflag AS name, last(l_linestatus || l_linenumber ORDER BY l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey, l_linestatus || l_linenumber) AS body FROM lineitem GROUP BY ALL")
def merged_macros(spark, sf_dir):
    """Macros by name, the last source's body."""
    i = table(spark, sf_dir, "lineitem")
    rows = i.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber").cast("long") * 1_000_000_000_000 + F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("pos"), F.create_map(F.col("l_returnflag"), F.concat("l_linestatus", F.col("l_linenumber").cast("string"))).alias("macros"))
    return W.merged_macros(rows)


@query(f"WITH {TYPED.sql}, {EDGES.sql} SELECT id, 'json:{{\"kind\":\"' || kind || '\",\"label\":\"' || coalesce(label, '') || '\"}}' AS stored, label IS NOT NULL AS had_label FROM typed WHERE kind IS NOT NULL")
def tagged_properties(spark, sf_dir):
    """Nested properties as tagged text and read back."""
    rows = TYPED.frame(spark).where("kind is not null").select("id", "label", W.tagged(F.struct("kind", F.coalesce("label", F.lit("")).alias("label"))).alias("stored"))
    back = W.untagged(F.col("stored"), "kind string, label string")
    return rows.where(W.untagged(F.col("id"), "kind string").isNull()).select("id", "stored", ((back["label"] != "") | (F.coalesce("label", F.lit("none")) == "")).alias("had_label"))
