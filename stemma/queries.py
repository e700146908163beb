"""Named queries over the driver's tables, each with the same result in DuckDB's SQL where that can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stemma.functions import references as X
from stemma.functions import text as T
from stemma.functions import types as K
from stemma.operators import graph as G
from stemma.operators import ordered as O
from stemma.operators import predicates as P
from stemma.operators import relational as R
from stemma.operators import retrieval as V
from stemma.operators import segment as S
from stemma.registry import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]


# Conversations as documents of ordered units: retrieval.


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "role", "text")


def bag(units: DataFrame) -> DataFrame:
    return V.weighted_bag(units.select("doc_id", "pos", T.math_tokens(F.col("text")).alias("tokens"), F.lit(1).alias("weight")))


TOKENS = """
units AS (SELECT conv_id AS doc_id, turn AS pos, role, text FROM conversations),
tok AS (SELECT doc_id, pos, unnest(regexp_extract_all(lower(coalesce(text, '')), '\\\\[a-z]+|[a-z][a-z0-9_]*|\\d+(?:\\.\\d+)*')) AS token FROM units),
bag AS (SELECT doc_id, pos, token, count(*) AS tf FROM tok WHERE NOT regexp_full_match(token, '[a-z]') GROUP BY ALL),
len AS (SELECT doc_id, pos, sum(tf) AS length FROM bag GROUP BY ALL),
siz AS (SELECT u.doc_id, count(*) AS n, greatest(coalesce(sum(length), 0) / count(*), 1.0) AS average FROM units u LEFT JOIN len USING (doc_id, pos) GROUP BY ALL),
fre AS (SELECT doc_id, token, count(*) AS df FROM bag GROUP BY ALL),
pst AS (SELECT doc_id, pos, token, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * length / average)) AS w
        FROM bag JOIN len USING (doc_id, pos) JOIN fre USING (doc_id, token) JOIN siz USING (doc_id)),
sco AS (SELECT q.doc_id, q.pos AS dependent, p.pos AS support, sum(w) AS score FROM bag q JOIN pst p ON q.doc_id = p.doc_id AND q.token = p.token AND p.pos < q.pos GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY doc_id, dependent ORDER BY round(score, 9) DESC, support) AS rank FROM sco QUALIFY rank <= 20),
seq AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS s FROM units),
loc AS (SELECT a.doc_id, a.pos AS dependent, b.pos AS support, 1 / (a.s - b.s) AS score, a.s - b.s AS rank FROM seq a JOIN seq b ON a.doc_id = b.doc_id AND b.s BETWEEN a.s - 8 AND a.s - 1),
cha AS (SELECT doc_id, dependent, support, 'bm25f' AS channel, rank FROM bm UNION ALL SELECT doc_id, dependent, support, 'local_window', rank FROM loc),
fus AS (SELECT doc_id, dependent, support, sum(1 / (60 + rank)) AS rrf, list_sort(list(DISTINCT channel)) AS channels, min(rank) <= 2 AS protected FROM cha GROUP BY ALL),
cand AS (SELECT f.*, CASE WHEN role = 'system' OR role = 'user' THEN 'definition' ELSE 'logic' END AS kind FROM fus f JOIN units u ON u.doc_id = f.doc_id AND u.pos = f.support),
pl AS (SELECT *, row_number() OVER (PARTITION BY doc_id, dependent, kind ORDER BY round(rrf, 9) DESC, support) AS place,
       least(2, count(*) FILTER (kind = 'definition') OVER (PARTITION BY doc_id, dependent)) AS used FROM cand),
fin AS (SELECT * FROM pl WHERE place <= CASE WHEN kind = 'definition' THEN 2 ELSE 3 + 2 - used END)
"""


@query(f"WITH {TOKENS} SELECT doc_id, dependent, support, round(score, 6) AS score, rank FROM bm")
def bm25_predecessors(spark, sf_dir):
    """The 20 best earlier turns of each turn by BM25."""
    return _bm25(turns(spark, sf_dir)).select("doc_id", "dependent", "support", F.round("score", 6).alias("score"), "rank")


def _bm25(units: DataFrame) -> DataFrame:
    b = bag(units)
    return V.ranked(V.predecessor_scores(b, V.bm25_postings(units, b)), 20)


@query(f"WITH {TOKENS} SELECT doc_id, token, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) AS idf FROM fre JOIN siz USING (doc_id)")
def bm25_stats(spark, sf_dir):
    """Document frequency and inverse document frequency of each token of each conversation."""
    u = turns(spark, sf_dir)
    sizes, _, frequency = V.document_statistics(u, bag(u))
    return frequency.join(sizes, "doc_id").select("doc_id", "token", "df", F.round(V.idf(F.col("n"), F.col("df")), 9).alias("idf"))


@query(f"WITH {TOKENS} SELECT doc_id, token, df FROM fre JOIN siz USING (doc_id) WHERE df <= greatest(3, ceil(n * 0.2))")
def idf_rare_tokens(spark, sf_dir):
    """Tokens rare enough to point at a unit."""
    u = turns(spark, sf_dir)
    sizes, _, frequency = V.document_statistics(u, bag(u))
    return V.rare_tokens(sizes, frequency)


@query(f"WITH {TOKENS} SELECT doc_id, dependent, support, round(score, 9) AS score, rank FROM loc")
def local_window(spark, sf_dir):
    """The last eight earlier turns of each turn."""
    return V.local_window(turns(spark, sf_dir)).withColumn("score", F.round("score", 9))


def _channels(units: DataFrame) -> DataFrame:
    b = _bm25(units).select("doc_id", "dependent", "support", F.lit("bm25f").alias("channel"), "rank")
    return b.unionByName(V.local_window(units).select("doc_id", "dependent", "support", F.lit("local_window").alias("channel"), "rank"))


@query(f"WITH {TOKENS} SELECT doc_id, dependent, support, round(rrf, 9) AS rrf, array_to_string(channels, ',') AS channels, protected FROM fus")
def rrf_fusion(spark, sf_dir):
    """Reciprocal-rank fusion of two channels."""
    return V.fused(_channels(turns(spark, sf_dir))).withColumns({"rrf": F.round("rrf", 9), "channels": F.array_join("channels", ",")})


def _candidates(units: DataFrame) -> DataFrame:
    kind = F.when(F.col("role").isin("system", "user"), "definition").otherwise("logic")
    return V.fused(_channels(units)).join(units.select("doc_id", F.col("pos").alias("support"), kind.alias("kind")), ["doc_id", "support"])


def _small_selection(units: DataFrame) -> DataFrame:
    """The selection of `fin`: small budgets, by fusion score alone. _selected has the reference's."""
    return V.final_selection(_candidates(units), 3, 2, [F.desc(F.round("rrf", 9)), F.col("support")])


@query(f"WITH {TOKENS} SELECT doc_id, dependent, support, kind, place FROM fin")
def final_selection_budget(spark, sf_dir):
    """Final selection with a budget of two definitions and three others, unused definition places passed on."""
    return _small_selection(turns(spark, sf_dir)).select("doc_id", "dependent", "support", "kind", "place")


@query(
    f"""WITH {TOKENS}, c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, dependent, kind ORDER BY protected DESC, round(rrf, 9) DESC, dependent - support, support) AS k FROM cand),
    d AS (SELECT * FROM c WHERE kind <> 'definition' OR k <= 2)
    SELECT doc_id, dependent, support, kind, row_number() OVER (PARTITION BY doc_id, dependent ORDER BY protected DESC, round(rrf, 9) DESC, dependent - support, support) AS place FROM d QUALIFY place <= 6"""
)
def pre_rerank_cap(spark, sf_dir):
    """The cap before reranking: six in all, two definitions."""
    got = _candidates(turns(spark, sf_dir)).withColumn("alias", F.lit(False))
    return V.capped(got, 6, 2).select("doc_id", "dependent", "support", "kind", "place")


@query(
    f"""WITH {TOKENS}, gold AS (SELECT a.doc_id, a.pos AS dependent, b.pos AS support FROM seq a JOIN seq b ON a.doc_id = b.doc_id AND b.s = a.s - 3),
    hit AS (SELECT g.*, f.support IS NOT NULL AS hit FROM gold g LEFT JOIN (SELECT DISTINCT doc_id, dependent, support FROM fin) f USING (doc_id, dependent, support)),
    per AS (SELECT count(*) AS n FROM fin GROUP BY doc_id, dependent)
    , rep AS (SELECT count(*) AS n_gold, round(avg(hit::INT), 9) AS recall, count(*) FILTER (dependent - support > 30) AS n_far,
    round(count(*) FILTER (dependent - support > 30 AND hit) / nullif(count(*) FILTER (dependent - support > 30), 0), 9) AS far_recall,
    (SELECT coalesce(max(n), 0) FROM per) AS most, round((SELECT coalesce(avg(n), 0) FROM per), 9) AS average FROM hit)
    SELECT *, coalesce(recall >= 0.95 AND coalesce(far_recall >= 0.9, true) AND most <= 30, false) AS accepted FROM rep"""
)
def candidate_recall_eval(spark, sf_dir):
    """Recall of the final selection against pairs three turns apart, and the acceptance gate."""
    u = turns(spark, sf_dir)
    return _recall(_small_selection(u), u)


def _recall(selected: DataFrame, units: DataFrame) -> DataFrame:
    third = F.lag("pos", 3).over(Window.partitionBy("doc_id").orderBy("pos"))
    gold = units.select("doc_id", F.col("pos").alias("dependent"), third.alias("support"), F.lit(False).alias("explicit")).where("support is not null")
    out = V.accepted(V.evaluation(selected, gold))
    return out.withColumns({c: F.round(c, 9) for c in ("recall", "far_recall", "average")})


@query(f"WITH {TOKENS} SELECT CASE WHEN dependent - support <= 5 THEN '1-5' WHEN dependent - support <= 30 THEN '6-30' ELSE '>30' END AS bucket, count(*) AS n FROM fin GROUP BY ALL")
def distance_buckets(spark, sf_dir):
    """Selected candidates by distance."""
    fin = _small_selection(turns(spark, sf_dir))
    return fin.groupBy(V.distance_bucket(F.col("dependent") - F.col("support")).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {TOKENS}, ex AS (SELECT a.doc_id, a.pos AS dependent, b.pos AS support FROM seq a JOIN seq b ON a.doc_id = b.doc_id AND b.s = a.s - 3),
    g AS (SELECT s.doc_id, s.dependent, e.support, max(1 / (s.rank + ln(1 + s.dependent - e.support))) AS score FROM bm s JOIN ex e ON s.doc_id = e.doc_id AND s.support = e.dependent WHERE s.rank <= 5 GROUP BY ALL)
    SELECT doc_id, dependent, support, round(score, 6) AS score, row_number() OVER (PARTITION BY doc_id, dependent ORDER BY round(score, 9) DESC, support) AS rank FROM g QUALIFY rank <= 10"""
)
def graph_expansion(spark, sf_dir):
    """Supports of each turn's best candidates' own supports."""
    u = turns(spark, sf_dir)
    third = F.lag("pos", 3).over(Window.partitionBy("doc_id").orderBy("pos"))
    explicit = u.select("doc_id", F.col("pos").alias("dependent"), third.alias("support")).where("support is not null")
    return V.expanded(_bm25(u), explicit).withColumn("score", F.round("score", 6))


@query(f"WITH {TOKENS} SELECT doc_id, dependent, support, substr(sha256(dependent::VARCHAR || chr(0) || support::VARCHAR || chr(0) || kind), 1, 24) AS candidate_id FROM fin")
def candidate_ids(spark, sf_dir):
    """Stable ids of the selected candidates."""
    fin = _small_selection(turns(spark, sf_dir))
    return fin.select("doc_id", "dependent", "support", V.candidate_id(F.col("dependent"), F.col("support"), F.col("kind")).alias("candidate_id"))


# The same with the reference's budgets and order: 80 in all and 40 definitions before reranking, then 10 definitions and
# 20 others. Without aliases and rerank scores the order is protection, fusion score, distance.
SELECTED = f"""{TOKENS},
ck AS (SELECT *, row_number() OVER (PARTITION BY doc_id, dependent, kind ORDER BY protected DESC, round(rrf, 9) DESC, dependent - support, support) AS k FROM cand),
cap AS (SELECT doc_id, dependent, support, kind, rrf, channels, protected, row_number() OVER (PARTITION BY doc_id, dependent ORDER BY protected DESC, round(rrf, 9) DESC, dependent - support, support) AS place
        FROM ck WHERE kind <> 'definition' OR k <= 40 QUALIFY place <= 80),
wp AS (SELECT * EXCLUDE (place), row_number() OVER (PARTITION BY doc_id, dependent, kind ORDER BY protected DESC, round(rrf, 9) DESC, dependent - support) AS place,
       least(10, count(*) FILTER (kind = 'definition') OVER (PARTITION BY doc_id, dependent)) AS used FROM cap),
sel AS (SELECT * FROM wp WHERE place <= CASE WHEN kind = 'definition' THEN 10 ELSE 20 + 10 - used END)
"""


def _capped(units: DataFrame) -> DataFrame:
    return V.capped(_candidates(units).withColumn("alias", F.lit(False)))


def _selected(units: DataFrame) -> DataFrame:
    return V.final_selection(_capped(units).drop("place"))


@query(f"WITH {SELECTED} SELECT doc_id, dependent, support, kind, place FROM cap")
def pre_rerank_cap_whole(spark, sf_dir):
    """The reference's cap before reranking: 80 in all, 40 definitions."""
    return _capped(turns(spark, sf_dir)).select("doc_id", "dependent", "support", "kind", "place")


@query(f"WITH {SELECTED} SELECT doc_id, dependent, support, kind, place FROM sel")
def final_selection_whole(spark, sf_dir):
    """The reference's final selection: 10 definitions and 20 others, unused definition places passed on."""
    return _selected(turns(spark, sf_dir)).select("doc_id", "dependent", "support", "kind", "place")


@query(
    f"""WITH {SELECTED}, gold AS (SELECT a.doc_id, a.pos AS dependent, b.pos AS support FROM seq a JOIN seq b ON a.doc_id = b.doc_id AND b.s = a.s - 3),
    hit AS (SELECT g.*, f.support IS NOT NULL AS hit FROM gold g LEFT JOIN (SELECT DISTINCT doc_id, dependent, support FROM sel) f USING (doc_id, dependent, support)),
    per AS (SELECT count(*) AS n FROM sel GROUP BY doc_id, dependent)
    , rep AS (SELECT count(*) AS n_gold, round(avg(hit::INT), 9) AS recall, count(*) FILTER (dependent - support > 30) AS n_far,
    round(count(*) FILTER (dependent - support > 30 AND hit) / nullif(count(*) FILTER (dependent - support > 30), 0), 9) AS far_recall,
    (SELECT coalesce(max(n), 0) FROM per) AS most, round((SELECT coalesce(avg(n), 0) FROM per), 9) AS average FROM hit)
    SELECT *, coalesce(recall >= 0.95 AND coalesce(far_recall >= 0.9, true) AND most <= 30, false) AS accepted FROM rep"""
)
def candidate_recall_whole(spark, sf_dir):
    """Recall of the reference's final selection against pairs three turns apart, and the acceptance gate."""
    u = turns(spark, sf_dir)
    return _recall(_selected(u), u)


@query(
    f"""WITH {SELECTED}, gold AS (SELECT a.doc_id, a.pos AS dependent, b.pos AS support, CASE WHEN b.role IN ('system', 'user') THEN 'definition' ELSE 'logic' END AS kind FROM seq a JOIN seq b ON a.doc_id = b.doc_id AND b.s = a.s - 3),
    hit AS (SELECT g.*, f.support IS NOT NULL AS hit, len(f.channels) = 1 AS alone FROM gold g LEFT JOIN sel f USING (doc_id, dependent, support, kind)),
    per AS (SELECT count(*) AS n, count(*) FILTER (kind = 'definition') AS d FROM sel GROUP BY doc_id, dependent),
    rep AS (SELECT count(*) AS n_gold, avg(hit::INT) AS recall, count(*) FILTER (kind = 'logic') AS n_logic, avg(hit::INT) FILTER (kind = 'logic') AS recall_logic,
    count(*) FILTER (kind = 'definition') AS n_definition, avg(hit::INT) FILTER (kind = 'definition') AS recall_definition,
    count(*) FILTER (kind = 'logic' AND dependent - support > 30) AS n_far, avg(hit::INT) FILTER (kind = 'logic' AND dependent - support > 30) AS far_recall,
    (SELECT count(*) FROM sel) AS n_selected, (SELECT coalesce(max(n), 0) FROM per) AS most, (SELECT coalesce(max(d), 0) FROM per) AS most_definitions,
    (SELECT count(*) FROM cap WHERE list_contains(channels, 'bm25f')) AS n_bm25f, (SELECT count(*) FROM cap WHERE list_contains(channels, 'local_window')) AS n_local_window,
    count(*) FILTER (hit AND alone) AS n_exclusive FROM hit)
    SELECT * REPLACE (round(recall, 9) AS recall, round(recall_logic, 9) AS recall_logic, round(recall_definition, 9) AS recall_definition, round(far_recall, 9) AS far_recall),
    coalesce(recall >= 0.95 AND coalesce(far_recall >= 0.9, true) AND most <= 30 AND most_definitions <= 10, false) AS accepted FROM rep"""
)
def candidate_evaluation(spark, sf_dir):
    """The reference's evaluation by kind, of its final selection against pairs three turns apart, and its whole gate."""
    u = turns(spark, sf_dir)
    key = ["doc_id", "dependent", "support", "kind"]
    pre = _capped(u).drop("place")
    marked = pre.join(V.final_selection(pre).select(*key, F.lit(True).alias("selected")), key, "left").withColumn("selected", F.coalesce("selected", F.lit(False)))
    w = Window.partitionBy("doc_id").orderBy("pos")
    kind = F.when(F.lag("role", 3).over(w).isin("system", "user"), "definition").otherwise("logic")
    gold = u.select("doc_id", F.col("pos").alias("dependent"), F.lag("pos", 3).over(w).alias("support"), kind.alias("kind"), F.lit(False).alias("explicit")).where("support is not null")
    out = V.accepted(V.evaluation_by_kind(marked, gold))
    counts = {f"n_{c}": F.coalesce(F.try_element_at("channel_counts", F.lit(c)), F.lit(0)) for c in ("bm25f", "local_window")}
    alone = F.aggregate(F.map_values("exclusive_hits"), F.lit(0).cast("long"), lambda a, x: a + x)
    rounded = {c: F.round(c, 9) for c in ("recall", "recall_logic", "recall_definition", "far_recall")}
    out = out.withColumns({**counts, "n_exclusive": alone, **rounded})
    return out.select("n_gold", "recall", "n_logic", "recall_logic", "n_definition", "recall_definition", "n_far", "far_recall", "n_selected", "most", "most_definitions", "n_bm25f", "n_local_window", "n_exclusive", "accepted")


@query(f"WITH {SELECTED} SELECT CASE WHEN dependent - support <= 5 THEN '1-5' WHEN dependent - support <= 30 THEN '6-30' ELSE '>30' END AS bucket, count(*) AS n FROM sel GROUP BY ALL")
def distance_buckets_whole(spark, sf_dir):
    """Candidates of the reference's final selection by distance."""
    return _selected(turns(spark, sf_dir)).groupBy(V.distance_bucket(F.col("dependent") - F.col("support")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"WITH {SELECTED} SELECT doc_id, dependent, support, substr(sha256(dependent::VARCHAR || chr(0) || support::VARCHAR || chr(0) || kind), 1, 24) AS candidate_id FROM sel")
def candidate_ids_whole(spark, sf_dir):
    """Stable ids of the candidates of the reference's final selection."""
    return _selected(turns(spark, sf_dir)).select("doc_id", "dependent", "support", V.candidate_id(F.col("dependent"), F.col("support"), F.col("kind")).alias("candidate_id"))


# Implicit candidates only. A turn's parent is its block (a user's turn opens one); turns of system and user are definitions,
# those of the assistant statements; explicit are the pairs of blocks that turns three apart lie in, from every third turn on.
IMPLICIT = f"""{TOKENS},
blk AS (SELECT doc_id, pos, s, role, (sum(CASE WHEN role = 'user' OR s = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))::VARCHAR AS parent,
        role IN ('system', 'user') AS definition, role = 'assistant' AS statement FROM seq),
exc AS (SELECT DISTINCT a.doc_id, a.parent AS dp, b.parent AS sp FROM blk a JOIN blk b ON a.doc_id = b.doc_id AND b.s = a.s - 3 WHERE a.s % 3 = 0),
ipr AS (SELECT a.doc_id, a.pos AS dependent, b.pos AS support, a.s AS sa, b.s AS sb, CASE WHEN b.definition THEN 'definition' ELSE 'logic' END AS kind
        FROM blk a JOIN blk b ON a.doc_id = b.doc_id AND b.pos < a.pos AND a.parent <> b.parent AND (b.definition OR (b.statement AND a.statement)) WHERE NOT EXISTS (FROM exc e WHERE e.doc_id = a.doc_id AND e.dp = a.parent AND e.sp = b.parent)),
ibm AS (SELECT doc_id, dependent, support, kind, score, row_number() OVER (PARTITION BY doc_id, dependent, kind ORDER BY round(score, 9) DESC, support) AS rank
        FROM sco JOIN ipr USING (doc_id, dependent, support) QUALIFY rank <= CASE WHEN kind = 'definition' THEN 15 ELSE 20 END),
iwn AS (SELECT doc_id, dependent, support, kind, 1 / (sa - sb) AS score, row_number() OVER (PARTITION BY doc_id, dependent ORDER BY sb DESC) AS rank FROM ipr WHERE kind = 'logic' QUALIFY rank <= 8)
"""


def _parents(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units with parent, definition and statement, and the explicit pairs of parents."""
    u = O.blocks(units, "doc_id", "pos", F.col("role") == "user").withColumn("parent", F.col("block").cast("string"))
    u = u.withColumns({"definition": F.col("role").isin("system", "user"), "statement": F.col("role") == "assistant"})
    w = Window.partitionBy("doc_id").orderBy("pos")
    pairs = u.select("doc_id", F.col("parent").alias("dependent_parent"), F.lag("parent", 3).over(w).alias("support_parent"), F.row_number().over(w).alias("s"))
    return u, pairs.where("support_parent is not null and s % 3 = 0").drop("s")


@query(f"WITH {IMPLICIT} SELECT doc_id, dependent, support, kind, round(score, 6) AS score, rank FROM ibm")
def bm25_implicit(spark, sf_dir):
    """Of the pairs that may be implicit relations, each turn's 20 best logic and 15 best definition supports by BM25."""
    t = turns(spark, sf_dir)
    b = bag(t)
    fit = V.implicit_pairs(V.predecessor_scores(b, V.bm25_postings(t, b)), *_parents(t))
    best = V.ranked(fit, 20, ("doc_id", "dependent", "kind")).where("kind = 'logic' or rank <= 15")
    return best.select("doc_id", "dependent", "support", "kind", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {IMPLICIT} SELECT doc_id, dependent, support, kind, round(score, 9) AS score, rank FROM iwn")
def local_window_implicit(spark, sf_dir):
    """The last eight earlier turns that may be each turn's implicit logic support."""
    return V.implicit_window(*_parents(turns(spark, sf_dir))).withColumn("score", F.round("score", 9))


def _implicit_candidates(spark, sf_dir) -> DataFrame:
    """The two channels of implicit pairs, fused by kind."""
    both = bm25_implicit(spark, sf_dir).select("doc_id", "dependent", "support", "kind", F.lit("bm25f").alias("channel"), "rank")
    both = both.unionByName(local_window_implicit(spark, sf_dir).select("doc_id", "dependent", "support", "kind", F.lit("local_window").alias("channel"), "rank"))
    return V.fused(both, by=("doc_id", "dependent", "support", "kind"))


IFUSED = f"""{IMPLICIT},
ifu AS (SELECT doc_id, dependent, support, kind, sum(1 / (60 + rank)) AS rrf, list_sort(list(DISTINCT channel)) AS channels, min(rank) <= 2 AS protected
        FROM (SELECT doc_id, dependent, support, kind, 'bm25f' AS channel, rank FROM ibm UNION ALL SELECT doc_id, dependent, support, kind, 'local_window', rank FROM iwn) GROUP BY ALL)
"""


@query(f"WITH {IFUSED} SELECT doc_id, dependent, support, kind, round(rrf, 9) AS rrf, array_to_string(channels, ',') AS channels, protected FROM ifu")
def rrf_fusion_implicit(spark, sf_dir):
    """Reciprocal-rank fusion of the channels of implicit pairs."""
    return _implicit_candidates(spark, sf_dir).withColumns({"rrf": F.round("rrf", 9), "channels": F.array_join("channels", ",")})


@query(
    f"""WITH {IFUSED}, ck AS (SELECT *, row_number() OVER (PARTITION BY doc_id, dependent, kind ORDER BY protected DESC, round(rrf, 9) DESC, dependent - support) AS k FROM ifu),
    cap AS (SELECT *, row_number() OVER (PARTITION BY doc_id, dependent ORDER BY protected DESC, round(rrf, 9) DESC, dependent - support, support) AS pre FROM ck WHERE kind <> 'definition' OR k <= 40 QUALIFY pre <= 80),
    wp AS (SELECT *, row_number() OVER (PARTITION BY doc_id, dependent, kind ORDER BY protected DESC, round(rrf, 9) DESC, dependent - support) AS place,
    least(10, count(*) FILTER (kind = 'definition') OVER (PARTITION BY doc_id, dependent)) AS used FROM cap)
    SELECT doc_id, dependent, support, kind, place FROM wp WHERE place <= CASE WHEN kind = 'definition' THEN 10 ELSE 20 + 10 - used END"""
)
def final_selection_implicit(spark, sf_dir):
    """The reference's final selection of implicit pairs."""
    cap = V.capped(_implicit_candidates(spark, sf_dir).withColumn("alias", F.lit(False)))
    return V.final_selection(cap.drop("place")).select("doc_id", "dependent", "support", "kind", "place")


@query("""SELECT q.vec_id AS dependent, e.vec_id AS support, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rank
    FROM embeddings q JOIN embeddings e ON e.vec_id < q.vec_id WHERE q.vec_id % 100 = 0 QUALIFY rank <= 20""")
def dense_topk_predecessors(spark, sf_dir):
    """The 20 nearest earlier vectors of each query vector (those whose id is divisible by 100), against all."""
    e = table(spark, sf_dir, "embeddings")
    found = V.nearest_before(e, e.where("vec_id % 100 = 0"), 20).withColumn("score", F.round("score", 6))
    return V.ranked(found, 20, ("dependent",))


# Events, conversations and documents in order.


@query("""SELECT e.event_id, p.event_id AS previous FROM (SELECT * FROM events WHERE event_type = 'purchase') e
    ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY ALL) p ON e.user_id = p.user_id AND e.ts > p.ts""")
def asof_latest_before(spark, sf_dir):
    """Each purchase with the user's latest click before it."""
    e = table(spark, sf_dir, "events")
    clicks = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("previous"))
    return O.latest_before(e.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), clicks, "user_id", "ts", "previous").select("event_id", "previous")


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events)
    SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN pos END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS target FROM s""")
def nearest_previous_same_type_30(spark, sf_dir):
    """The place of the nearest click within the 30 events before each event of a user."""
    e = table(spark, sf_dir, "events").withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return O.previous_of_type(e, "user_id", "pos", F.col("event_type") == "click").select("event_id", "target")


SPANS = """sp AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + (abs(value) * 1e6)::BIGINT AS e FROM events),
    m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
    u AS (SELECT user_id, island, min(s) AS "start", max(e) AS "end", count(*) AS n FROM i GROUP BY ALL)"""


def _spans(spark, sf_dir) -> DataFrame:
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("user_id", start.alias("start"), (start + F.round(F.abs("value") * 1e6).cast("long")).alias("end"))


@query(f'WITH {SPANS} SELECT user_id, "start", "end", n FROM u')
def interval_union(spark, sf_dir):
    """Each user's events as spans, overlapping and touching ones joined."""
    return O.merged_spans(_spans(spark, sf_dir), "user_id")


@query(f"""WITH {SPANS} SELECT user_id, "start", "end" FROM (
    SELECT user_id, lag("end") OVER (PARTITION BY user_id ORDER BY "start") AS "start", "start" AS "end" FROM u) WHERE "start" < "end" """)
def interval_gaps(spark, sf_dir):
    """The times between each user's spans."""
    return O.gaps(_spans(spark, sf_dir), "user_id", F.lit(None).cast("long"), F.lit(None).cast("long"))


@query("""SELECT conv_id, turn, sum(CASE WHEN role = 'user' OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS block
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)""")
def block_sessions(spark, sf_dir):
    """Blocks of turns: a user's turn opens one."""
    return O.blocks(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "block")


@query("""SELECT conv_id, turn, array_to_string(coalesce(list(text) FILTER (text IS NOT NULL) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []), '|') AS before,
    array_to_string(coalesce(list(text) FILTER (text IS NOT NULL) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), []), '|') AS after FROM conversations""")
def neighbour_context(spark, sf_dir):
    """The two turns on either side of each turn, joined."""
    got = O.neighbours(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("text"), 2)
    return got.select("conv_id", "turn", F.array_join("before", "|").alias("before"), F.array_join("after", "|").alias("after"))


@query("""SELECT conv_id, turn, coalesce(list(text) FILTER (text IS NOT NULL) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []) AS before,
    coalesce(list(text) FILTER (text IS NOT NULL) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), []) AS after FROM conversations""")
def neighbour_context_whole(spark, sf_dir):
    """The whole texts of the two turns on either side of each turn."""
    return O.neighbours(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("text"), 2).select("conv_id", "turn", "before", "after")


@query("""SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS total FROM events
    WINDOW w AS (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW)""")
def trailing_minute_rate(spark, sf_dir):
    """Events and their value over the minute up to each event, by type."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return O.trailing(e, "event_type", "ts", 60, F.col("value")).select("event_id", "n", F.round("total", 4).alias("total"))


@query("""SELECT doc_id, count(*) AS n_units, count(DISTINCT p) AS n_distinct, max(length(p)) AS longest FROM (
    SELECT doc_id, unnest(regexp_split_to_array(text, '\\n[ \\t]*\\n+|\\n')) AS p FROM documents) WHERE trim(p) <> '' GROUP BY ALL""")
def paragraph_units(spark, sf_dir):
    """Paragraphs and lines of each document."""
    d = table(spark, sf_dir, "documents")
    p = d.select("doc_id", F.explode(F.split("text", "\\n[ \\t]*\\n+|\\n")).alias("p")).where(F.trim("p") != "")
    return p.groupBy("doc_id").agg(F.count("*").alias("n_units"), F.count_distinct("p").alias("n_distinct"), F.max(F.length("p")).alias("longest"))


# Text of documents and pages.


@query("""SELECT md5(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g'))) AS global_id, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY ALL""")
def dedup_by_content_hash(spark, sf_dir):
    """Documents by the hash of their normal form: the first kept, copies counted."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.content_id(F.col("text")).alias("global_id"))
    return d.groupBy("global_id").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@query("""SELECT CASE WHEN quality IS NULL THEN 'manual_review' WHEN quality = 0 AND regexp_matches(text, '[=<>+]|[0-9]') THEN 'manual_review' WHEN quality = 0 THEN 'quarantine' ELSE 'keep' END AS action,
    count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL""")
def quality_partition(spark, sf_dir):
    """Cleaning decisions: missing ones are reviewed, and so are rejected texts with signs of mathematics."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    action = F.when(F.col("quality").isNull(), "manual_review").when((F.col("quality") == 0) & F.col("text").rlike("[=<>+]|[0-9]"), "manual_review").when(F.col("quality") == 0, "quarantine").otherwise("keep")
    return d.groupBy(action.alias("action")).agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '([?&])(?:signature|token|access_token|expires|ossaccesskeyid|x-oss-signature|x-amz-signature|x-amz-credential|x-amz-security-token|utm_source|ref)=[^&#]*', '\\1', 'gi'), '&{2,}', '&', 'g'), '\\?&+', '?', 'g'), '[?&]+(#|$)', '\\1', 'g') AS url FROM pages""")
def redact_urls(spark, sf_dir):
    """Page urls without signing and tracking parameters."""
    return table(spark, sf_dir, "pages").select("page_id", T.redact_url(F.col("url")).alias("url"))


@query("""SELECT page_id, CASE WHEN regexp_matches(h, '特例|特殊情形|特化|是.*的特例|special case', 'i') THEN 'specializes' WHEN regexp_matches(h, '推广|一般化|generaliz', 'i') THEN 'generalizes'
    WHEN regexp_matches(h, '等价|充要|iff|equivalent', 'i') THEN 'equivalent' WHEN regexp_matches(h, '反例|矛盾|否定|contradict|counterexample', 'i') THEN 'contradicts'
    WHEN regexp_matches(h, '举例|例证|示例|exemplif|instance of', 'i') THEN 'exemplifies' WHEN regexp_matches(h, '引用定义|定义引用|套用定义|uses? definition|based on (the )?definition', 'i') THEN 'defines'
    WHEN regexp_matches(h, '推导|推出|证明|导出|蕴含|derive|imply|prove', 'i') THEN 'derives' WHEN regexp_matches(h, '依赖|前置|先于|prerequisite|depend|需要|基于|建立在', 'i') THEN 'derives'
    WHEN regexp_matches(h, '使用|应用|利用|借助|调用|apply|use', 'i') THEN 'uses' ELSE 'related' END AS kind FROM (SELECT page_id, url || ' ' || html AS h FROM pages)""")
def edge_kind_classify(spark, sf_dir):
    """The edge taxonomy's rules over page texts."""
    return table(spark, sf_dir, "pages").select("page_id", G.edge_kind(F.col("url"), F.col("html")).alias("kind"))


@query("""SELECT event_type AS node_type, key, count(*) AS n FROM (SELECT event_type, unnest(json_keys(props)) AS key FROM events) GROUP BY ALL""")
def key_catalogue(spark, sf_dir):
    """Keys of the property objects by event type."""
    return R.catalogue(table(spark, sf_dir, "events").select(F.col("event_type").alias("node_type"), F.col("props").alias("json")))


@query("""SELECT event_id AS id, event_type AS node_type, json_extract_string(props, '$.k') AS k FROM events WHERE event_type IN ('click', 'purchase') AND json_extract_string(props, '$.k') IS NOT NULL""")
def path_projection(spark, sf_dir):
    """Clicks and purchases with the value at a path of their properties."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("node_type"), F.col("props").alias("json"))
    return R.selected_fields(e, ["click", "purchase"], {"k": "$.k"})


@query("""SELECT p_brand, count(*) AS n, count(*) FILTER (lower(trim(p_type)) IN ('定义', '公理', 'definition', 'axiom')) AS definitions,
    count(*) FILTER (lower(trim(p_type)) IN ('性质', '定理', '引理', '推论', 'property', 'theorem', 'lemma', 'proposition', 'corollary', 'claim', 'conjecture', 'problem', 'observation', 'fact')) AS relations,
    count(DISTINCT lower(trim(p_type))) AS kinds FROM part GROUP BY ALL""")
def type_histogram(spark, sf_dir):
    """Parts by brand with the node-type predicates over their types."""
    t = F.col("p_type")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if(K.is_definition(t)).alias("definitions"), F.count_if(K.is_relation(t)).alias("relations"), F.count_distinct(K.normal_type(t)).alias("kinds"))


@query("""SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'cold') OR contains(lower(p_type), 'cold') ORDER BY p_partkey LIMIT 30""")
def substring_search(spark, sf_dir):
    """The first 30 parts whose name or type has the text."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_type")
    return R.found_text(p, ["name", "p_type"], "Cold").select("id", "name")


# Trade between nations as a graph.


def trade(spark, sf_dir) -> DataFrame:
    """src, dst, n: orders' customers' nations to the nations of the items' suppliers."""
    t = {n: table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem", "supplier")}
    o = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("src"))
    i = t["lineitem"].join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", F.col("s_nationkey").alias("dst"))
    return o.join(i, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("src", "dst").agg(F.count("*").alias("n"))


def nations(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("定理").alias("node_type"), F.col("n_name").alias("label"))


TRADE = """t AS (SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
    big AS (SELECT * FROM t WHERE n > (SELECT avg(n) FROM t)),
    deg AS (SELECT n_nationkey AS id, n_name AS label, (SELECT count(*) FROM big WHERE src = n_nationkey) + (SELECT count(*) FROM big WHERE dst = n_nationkey) AS degree FROM nation),
    sal AS (SELECT id, degree, 0.5 * 1.0 + 0.5 * ln(1 + degree) / ln(1 + (SELECT greatest(1, max(degree)) FROM deg)) + CASE WHEN regexp_matches(label, '[0-9]') THEN 0.15 ELSE 0 END AS salience FROM deg)"""


def big_trade(spark, sf_dir) -> DataFrame:
    t = trade(spark, sf_dir)
    return t.crossJoin(F.broadcast(t.agg(F.avg("n").alias("mean")))).where("n > mean").drop("mean")


@query(f"WITH {TRADE} SELECT src, dst, n FROM t")
def nation_trade_edges(spark, sf_dir):
    """Items ordered from one nation and supplied by another."""
    return trade(spark, sf_dir)


@query(f"WITH {TRADE} SELECT id, degree, round(salience, 9) AS salience FROM sal")
def nation_salience(spark, sf_dir):
    """Degree and salience of nations over large trade."""
    return G.salience(nations(spark, sf_dir), big_trade(spark, sf_dir)).withColumn("salience", F.round("salience", 9))


@query(f"WITH {TRADE} SELECT id, round(salience, 9) AS salience, row_number() OVER (ORDER BY round(salience, 9) DESC, id) AS place FROM sal QUALIFY place <= greatest(1, ceil((SELECT count(*) FROM sal) * 0.3))")
def major_nodes(spark, sf_dir):
    """The most salient three tenths of the nations."""
    s = G.salience(nations(spark, sf_dir), big_trade(spark, sf_dir)).select("id", F.round("salience", 9).alias("salience"))
    return G.major_nodes(s, 0.3)


@query(f"""WITH {TRADE}, e AS (SELECT DISTINCT * FROM (SELECT src, dst FROM big UNION ALL SELECT dst, src FROM big)),
    h1 AS (SELECT dst AS id, 1 AS hop FROM e WHERE src = 0), h2 AS (SELECT e.dst AS id, 2 AS hop FROM h1 JOIN e ON e.src = h1.id)
    SELECT id, min(hop) AS hop FROM (SELECT 0::INT AS id, 0 AS hop UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY id""")
def khop_neighbourhood(spark, sf_dir):
    """Nations within two steps of nation 0 over large trade."""
    start = spark.range(1).select(F.col("id").cast("int"))
    return G.neighbourhood(big_trade(spark, sf_dir), start, 2)


@query(f"""WITH {TRADE}, e AS (SELECT src::VARCHAR AS src, dst::VARCHAR AS dst, least(n // 4, 120) AS p FROM t WHERE src <> dst)
    SELECT a.src, a.dst, a.p::BIGINT AS n FROM e a LEFT JOIN e b ON b.src = a.dst AND b.dst = a.src WHERE b.src IS NULL OR a.p > b.p OR (a.p = b.p AND a.src::INT > b.src::INT)""")
def two_cycle_resolution(spark, sf_dir):
    """Trade without self-loops, of two opposite edges the one of longer reason, on ties the one whose start stands later."""
    reason = F.repeat(F.lit("x"), F.least(F.expr("n div 4"), F.lit(120)).cast("int"))
    e = trade(spark, sf_dir).withColumns({"relation": F.lit(G.LOGIC), "reason": reason, "pos": F.col("src") * 100 + F.col("dst")})
    order = nations(spark, sf_dir).select("id", F.col("id").alias("pos"))
    return G.filter_edges(e, order).select("src", "dst", F.char_length("reason").cast("long").alias("n"))


@query(f"""WITH {TRADE} SELECT src, a.n_name AS src_name, dst, b.n_name AS dst_name, n FROM big JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey""")
def pattern_match_one_hop(spark, sf_dir):
    """(a)-[trade]->(b) with both names."""
    return G.match_relations(nations(spark, sf_dir), big_trade(spark, sf_dir)).select("src", "src_name", "dst", "dst_name", "n")


@query("SELECT DISTINCT n_regionkey AS value FROM nation WHERE n_regionkey IS NOT NULL")
def distinct_values(spark, sf_dir):
    """Distinct values of a property."""
    return table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("value")).where("value is not null").distinct()


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey < 3 THEN 'renamed' ELSE n_name END AS name FROM nation UNION ALL SELECT 100, 'new'")
def node_upsert(spark, sf_dir):
    """Nations with three renamed and one added."""
    n = nations(spark, sf_dir).select("id", "name")
    rows = n.where("id < 3").withColumn("name", F.lit("renamed")).unionByName(spark.range(1).select(F.lit(100).alias("id"), F.lit("new").alias("name")))
    return G.upsert(n, rows, ["id"])


@query(f"WITH {TRADE} SELECT src, dst, n FROM big WHERE src >= 5 AND dst >= 5")
def detach_delete(spark, sf_dir):
    """Large trade after deleting the first five nations with their edges."""
    n = nations(spark, sf_dir)
    return G.detach_delete(n, big_trade(spark, sf_dir), n.where("id < 5"))[1]


@query("""WITH c AS (SELECT lower(p_brand) AS k, min(p_partkey) AS canonical FROM part GROUP BY ALL), m AS (SELECT p_partkey, canonical FROM part JOIN c ON lower(p_brand) = k)
    SELECT DISTINCT a.canonical AS src, b.canonical AS dst, l_returnflag AS label FROM lineitem JOIN m a ON l_partkey = a.p_partkey JOIN m b ON l_suppkey = b.p_partkey WHERE a.canonical <> b.canonical""")
def title_dedup_redirect(spark, sf_dir):
    """Parts collapsed by brand, item edges following."""
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("title"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("label"))
    return G.collapse_titles(nodes, edges)[1]


@query("""SELECT l_suppkey AS src, l_partkey AS dst, l_linestatus AS relation, string_agg(l_returnflag, '; ' ORDER BY p) AS reason, min(p) AS pos FROM (
    SELECT l_suppkey, l_partkey, l_linestatus, l_returnflag, min(l_orderkey * 10 + l_linenumber) AS p FROM lineitem GROUP BY ALL) GROUP BY ALL""")
def edge_merge_reasons(spark, sf_dir):
    """Item edges merged, each new reason appended."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_linestatus").alias("relation"), F.col("l_returnflag").alias("reason"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return G.merge_edges(e)


DAG = "p AS (SELECT p_partkey AS id, p_brand, p_size, lead(p_partkey) OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS nxt FROM part)"


@query(f"""WITH RECURSIVE {DAG}, w AS (SELECT id, 0 AS depth FROM p WHERE id NOT IN (SELECT nxt FROM p WHERE nxt IS NOT NULL) UNION ALL SELECT p.nxt, w.depth + 1 FROM w JOIN p ON p.id = w.id WHERE p.nxt IS NOT NULL)
    SELECT id, max(depth) AS depth, false AS cyclic FROM w GROUP BY id""")
def longest_depth_dag(spark, sf_dir):
    """Depths of parts, chained within brand and size."""
    return G.longest_depths(*_chains(spark, sf_dir))


def _chains(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    nxt = F.lead("p_partkey").over(Window.partitionBy("p_brand", "p_size").orderBy("p_partkey"))
    return p.select(F.col("p_partkey").alias("id")), p.select(F.col("p_partkey").alias("src"), nxt.alias("dst")).where("dst is not null")


@query(f"""WITH {DAG}, f AS (SELECT id, first_value(id) OVER (PARTITION BY p_brand, p_size ORDER BY id) AS component, count(*) OVER (PARTITION BY p_brand, p_size) AS size FROM p)
    SELECT id, component, size FROM f WHERE size >= 2""")
def components(spark, sf_dir):
    """Connected components of the part chains."""
    return G.components(_chains(spark, sf_dir)[1].toDF("x", "y"))


@query("""SELECT id, (dense_rank() OVER (ORDER BY kind) - 1) * 230 AS x, (row_number() OVER (PARTITION BY kind ORDER BY id) - 1) * 95 AS y FROM (SELECT p_partkey AS id, p_brand AS kind FROM part)""")
def swimlane_layout(spark, sf_dir):
    """Parts in lanes by brand."""
    return O.swimlanes(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("kind"), F.col("p_partkey").alias("pos"))).select("id", "x", "y")


@query("""WITH n AS (SELECT greatest(4, floor(sqrt(1.7 * count(*)) + 0.5))::INT AS cols FROM part), r AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) - 1 AS i, cols FROM part, n)
    SELECT id, (CASE WHEN (i // cols) % 2 = 1 THEN cols - 1 - i % cols ELSE i % cols END) * 230 AS x, (i // cols) * 160 AS y FROM r""")
def serpentine_layout(spark, sf_dir):
    """Parts on a serpentine grid."""
    return O.serpentine(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("pos"))).select("id", "x", "y")


@query("""SELECT id, (row_number() OVER (PARTITION BY depth ORDER BY id) - 1 - (count(*) OVER (PARTITION BY depth) - 1) / 2) * 215 AS x, depth * 165 AS y FROM (SELECT p_partkey AS id, p_size AS depth FROM part)""")
def dag_layers(spark, sf_dir):
    """Parts in layers by size."""
    return O.layered(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("pos"), F.col("p_size").alias("depth"))).select("id", "x", "y")


# Integrity, histories, queues.


@query("""SELECT 'order_without_customer' AS problem, o_orderkey AS id FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'item_without_order', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'customer_without_order', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)""")
def integrity_orphans(spark, sf_dir):
    """Orders without customer, items without order, customers without order."""
    t = {n: table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem")}
    a = R.orphans(t["orders"], t["customer"], "o_custkey", "c_custkey").select(F.lit("order_without_customer").alias("problem"), F.col("o_orderkey").alias("id"))
    b = R.orphans(t["lineitem"], t["orders"], "l_orderkey", "o_orderkey").select(F.lit("item_without_order").alias("problem"), F.col("l_orderkey").alias("id"))
    c = R.orphans(t["customer"], t["orders"], "c_custkey", "o_custkey").select(F.lit("customer_without_order").alias("problem"), F.col("c_custkey").alias("id"))
    return a.unionByName(b).unionByName(c)


@query("""SELECT coalesce(a.k, b.k) AS key, CASE WHEN b.k IS NULL THEN 'missing' ELSE 'orphan' END AS state FROM (SELECT DISTINCT l_partkey AS k FROM lineitem) a FULL JOIN (SELECT DISTINCT p_partkey AS k FROM part) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def version_reconciliation(spark, sf_dir):
    """Referenced parts that don't exist and parts that nothing refers to."""
    return R.reconciled(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key")), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key")), "key")


@query("""SELECT o_custkey AS owner, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders WHERE o_orderstatus <> 'F' QUALIFY place <= 3""")
def history_topn(spark, sf_dir):
    """The three newest open orders of each customer."""
    o = table(spark, sf_dir, "orders")
    h = o.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("deleted_at"))
    return R.newest_per_owner(h, 3).select("owner", "id", "place")


@query("SELECT c_custkey AS owner, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def storage_sum(spark, sf_dir):
    """Total of each customer's orders, 0 without any."""
    sums = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("t"))
    return table(spark, sf_dir, "customer").join(sums, "c_custkey", "left").select(F.col("c_custkey").alias("owner"), F.round(F.coalesce("t", F.lit(0.0)), 2).alias("total"))


@query("""SELECT s AS status, (SELECT count(*) FROM orders WHERE o_orderstatus = s) AS n FROM (VALUES ('F'), ('O'), ('P'), ('X')) v(s)""")
def outbox_status(spark, sf_dir):
    """Orders by status, with a status that doesn't occur."""
    return R.status_counts(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")), "status", ["F", "O", "P", "X"])


@query("""SELECT event_id AS id, least(3600, 30 * pow(2, least(attempts - 1, 7)))::INT AS wait FROM (SELECT event_id, ts, 1 + event_id % 12 AS attempts FROM events WHERE event_type = 'click') ORDER BY ts, event_id LIMIT 50""")
def outbox_due(spark, sf_dir):
    """The 50 oldest due entries of a queue with their back-off."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "click", "pending").otherwise("done").alias("status"), F.col("ts").alias("next_attempt_at"), F.col("ts").alias("lease_expires_at"), (1 + F.col("event_id") % 12).alias("attempts"))
    return R.due(e, F.lit("2100-01-01").cast("timestamp_ntz"), 50).select("id", R.backoff(F.col("attempts")).alias("wait"))


@query("""WITH e AS (SELECT user_id AS job, event_id % 3 AS token, event_id AS seq, CASE event_type WHEN 'error' THEN 'error' ELSE event_type END AS status FROM events),
    c AS (SELECT * FROM e QUALIFY token = max(token) OVER (PARTITION BY job)), f AS (SELECT *, min(CASE WHEN status = 'error' THEN seq END) OVER (PARTITION BY job) AS fail FROM c)
    SELECT job, arg_max(status, seq) AS status, count(*) AS n FROM f WHERE fail IS NULL OR seq <= fail GROUP BY ALL""")
def job_last_state(spark, sf_dir):
    """The state of each user's latest attempt, stale events dropped."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), (F.col("event_id") % 3).alias("token"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    return R.last_states(e)


@query("""SELECT count(*) AS expected, count(*) FILTER (o_orderkey IS NULL) AS failed, round(count(*) FILTER (o_orderkey IS NULL) / count(*), 9) AS ratio,
    (count(*) FILTER (o_orderkey IS NULL) / count(*)) > 0 AND (count(*) FILTER (o_orderkey IS NULL) / count(*)) <= 0.05 AS may_continue
    FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL) ON c_custkey = o_custkey""")
def task_failure_report(spark, sf_dir):
    """Customers without a settled order as failed tasks."""
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), (F.col("o_orderstatus") != "P").alias("ok"))
    return R.failure_report(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key")), done, "key").withColumn("ratio", F.round("ratio", 9))


# Predicate pairs.


@query("""WITH w AS (SELECT p_partkey AS id, p_brand AS arity, p_size, list_distinct(string_split(lower(p_name), ' ')) AS words FROM part)
    SELECT a.id AS x, b.id AS y, round(len(list_intersect(a.words, b.words)) / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))), 4) AS similarity
    FROM w a JOIN w b ON a.arity = b.arity AND a.p_size = b.p_size AND a.id < b.id""")
def jaccard_pairs(spark, sf_dir):
    """Parts of one brand and size, with the word overlap of their names."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_size", F.array_distinct(F.split(F.lower("p_name"), " ")).alias("words"))
    return P.word_overlaps(p, ["p_brand", "p_size"])


# Labels, references and units of texts.

_KINDS = "theorem|lemma|proposition|corollary|definition|claim|axiom|property|example|exercise|remark|conjecture|problem|observation|fact"
_NUMBERS = "[A-Za-z]?\\d+(?:[.\\-][A-Za-z0-9]+)*|[IVXLCDM]+|[A-Z]"


@query(f"""SELECT conv_id, turn, array_to_string(list_filter([
    CASE WHEN turn = min(turn) OVER (PARTITION BY conv_id) THEN 'document_initial' END,
    CASE WHEN regexp_matches(trim(text), '(?i)^(#{{1,6}}\\s|(?:chapter|section|appendix)\\b|第.+[章节])') THEN 'heading_like' END,
    CASE WHEN regexp_matches(trim(text), '(?i)^(proof|证明|证)([^\\pL\\pN_]|$)') THEN 'proof_like' END,
    CASE WHEN regexp_matches(trim(text), '(?i)^([(（][a-zivxlcdm0-9]+[)）]|[a-zivxlcdm][)])\\s') THEN 'subpart_like' END,
    CASE WHEN regexp_matches(regexp_extract(trim(text), '(?is)^(.*?)\\b(?:{_KINDS})\\s+(?:{_NUMBERS})\\b', 1), '(?i)(^|[^\\pL\\pN_])(?:by|see|from|using|according\\s+to|apply|follows\\s+from|theorem|lemma|proposition|corollary|definition|reference|参见|由|根据)([^\\pL\\pN_]|$)') THEN 'embedded_reference' END,
    CASE WHEN contains(text, chr(10) || chr(10)) THEN 'paragraph_boundary' END], lambda f: f IS NOT NULL), ',') AS flags FROM conversations""")
def unit_flags(spark, sf_dir):
    """Boundary evidence of each turn."""
    c = table(spark, sf_dir, "conversations")
    first = F.col("turn") == F.min("turn").over(Window.partitionBy("conv_id"))
    return c.select("conv_id", "turn", F.array_join(X.unit_flags(F.col("text"), first), ",").alias("flags"))


@query("""SELECT coalesce(CASE WHEN regexp_matches(line, '^#{1,6}\\s+\\S') THEN 'heading' END, 'none') AS kind, count(*) AS n, sum(length(line))::BIGINT AS chars
    FROM (SELECT trim(regexp_extract(text, '^\\s*([^\\n]*)', 1)) AS line FROM documents) GROUP BY ALL""")
def heading_labels(spark, sf_dir):
    """Documents by whether they start with a heading, with the length of their first lines."""
    d = table(spark, sf_dir, "documents").select(X.heading(F.col("text")).alias("h"), X.first_line(F.col("text")).alias("line"))
    return d.groupBy(F.when(F.col("h.kind").isNotNull(), "heading").otherwise("none").alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '(?i)(?:definition|theorem|proposition|lemma|corollary|property|axiom)s?\\s*[0-9]+(?:[.\\-][0-9]+)*'))
    + len(regexp_extract_all(text, '(?:定义|定理|命题|引理|推论|性质|公理)\\s*§?\\s*[0-9]+(?:[.\\-][0-9]+)*')) AS n FROM documents""")
def reference_hits(spark, sf_dir):
    """Explicit references in each document."""
    d = table(spark, sf_dir, "documents")
    hits = F.filter(X.reference_hits("text"), lambda h: h["kind"] == "explicit")
    return d.select("doc_id", F.size(hits).cast("long").alias("n"))


@query("""SELECT page_id, array_to_string(list_filter(['根据', '由', '利用', '结合', '依照', '按照', '应用', '依据', '可知', '可得', '得到', '推出', '得出', '于是', '因此', '同理可得', '故', '推知'], lambda v: contains(html, v)), ',') AS triggers FROM pages""")
def trigger_flags(spark, sf_dir):
    """Reference and deduction verbs in each page."""
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(X.triggers(F.col("html")), ",").alias("triggers"))


@query("SELECT md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS fingerprint, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY ALL")
def near_key_fingerprint(spark, sf_dir):
    """Documents alike in letters and digits."""
    key = F.md5(F.regexp_replace(F.lower("text"), "[^a-z0-9]", "").cast("binary"))
    return table(spark, sf_dir, "documents").groupBy(key.alias("fingerprint")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query()
def document_units(spark, sf_dir):
    """Structure-preserving units of every document, with their batches."""
    return S.document_units(table(spark, sf_dir, "documents"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey NOT IN (SELECT p_partkey FROM part) THEN 'missing_source' WHEN l_partkey NOT IN (SELECT p_partkey FROM part) THEN 'missing_target'
    WHEN l_suppkey = l_partkey THEN 'self_loop' END AS problem FROM lineitem""")
def edge_checks(spark, sf_dir):
    """Items as edges between parts, checked."""
    e = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return R.checked_edges(e, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))).select("l_orderkey", "l_linenumber", "problem")


from stemma import queries_anchor, queries_coverage, queries_review, queries_store, queries_syntax, queries_text  # noqa: E402, F401  register their queries
