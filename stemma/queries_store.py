"""Queries over predicates, match units, tasks, models, accounts and queues: literal samples beside the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemma.functions import text as T
from stemma.operators import accounts as A
from stemma.operators import evidence as E
from stemma.operators import nodes as N
from stemma.operators import predicates as P
from stemma.operators import relational as R
from stemma.operators import retrieval as V
from stemma.plans import stages
from stemma.registry import Sample, query, table

NAMES = Sample("names_", {"id": "int", "name": "string"}, [(1, "IsPrime"), (2, "is prime"), (3, "P_TMP_Divides"), (4, "tmp_SubsetOf_DUP_2"), (5, "P_X1"), (6, None), (7, "Élan vital"), (8, "HTTPServer2Go"), (9, "__a--b__")])
_SNAKE = "upper(trim(regexp_replace(regexp_replace(coalesce(name, ''), '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '_'))"


@query(f"""WITH {NAMES.sql}, k AS (SELECT id, upper(regexp_replace(coalesce(name, ''), '[^A-Za-z0-9]+', '', 'g')) AS name_key, {_SNAKE} AS snake_key FROM names_),
    i AS (SELECT *, regexp_replace(regexp_replace(snake_key, '^(P_)?TMP_', ''), '_DUP_\\d+$', '') AS bare FROM k) SELECT id, name_key, snake_key, CASE WHEN starts_with(bare, 'P_') THEN bare ELSE 'P_' || bare END AS predicate FROM i""")
def predicate_names(spark, sf_dir):
    """Name key, snake key and id of predicate names."""
    c = F.col("name")
    return NAMES.frame(spark).select("id", P.name_key(c).alias("name_key"), P.snake_key(c).alias("snake_key"), P.predicate_id(c).alias("predicate"))


SORTS = Sample("sorts_", {"id": "int", "a": "array<string>", "b": "array<string>"}, [(1, ["Set", "Int"], ["Set", "Int"]), (2, ["Set"], ["Entity"]), (3, ["Set"], ["Int"]), (4, ["Set"], ["Set", "Set"]), (5, [], []), (6, ["Entity", "Int"], ["Ring", "Real"])])


@query(f"WITH {SORTS.sql} SELECT id, len(a) = len(b) AND len(list_filter(range(1, len(a) + 1), lambda i: NOT (a[i] = b[i] OR a[i] = 'Entity' OR b[i] = 'Entity'))) = 0 AS fits FROM sorts_")
def sort_compatibility(spark, sf_dir):
    """Whether two signatures fit: as many sorts, each pair equal or with Entity."""
    return SORTS.frame(spark).select("id", P.sorts_compatible(F.col("a"), F.col("b")).alias("fits"))


IFFS = Sample("iffs", {"id": "int", "text": "string"}, [(1, "A iff B"), (2, "A 当且仅当 B 当且仅当 C"), (3, "x ⇔ y"), (4, "only this"), (5, None), (6, "p if and only if q \\iff r"), (7, "different"), (8, " iff B")])


@query(f"""WITH {IFFS.sql}, p AS (SELECT id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '(?i)\\s*(?:\\\\iff|\\\\Leftrightarrow|⇔|\\bif and only if\\b|\\biff\\b|当且仅当)\\s*'), lambda x: trim(x)), lambda x: x <> '') AS p FROM iffs),
    e AS (SELECT id, p, unnest(range(0, len(p))) AS i FROM p WHERE len(p) >= 2) SELECT id, p[i + 1] AS source, p[(i + 1) % len(p) + 1] AS target FROM e""")
def equivalence_directions(spark, sf_dir):
    """Both directions of two-part equivalences, the cycle of longer ones."""
    return IFFS.frame(spark).select("id", F.explode(N.iff_directions(F.col("text"))).alias("d")).select("id", "d.source", "d.target")


@query("""SELECT doc_id, g AS parent, CASE WHEN part IS NULL THEN g ELSE g || '__sub' || part END AS unit, CASE WHEN part IS NULL THEN text ELSE split_part(text, '. ', part) END AS text
    FROM (SELECT doc_id, 'g' || doc_id AS g, text, unnest(CASE WHEN doc_id % 3 = 0 THEN [1, 2] ELSE [NULL] END)::INT AS part FROM documents WHERE doc_id % 5 <> 0)""")
def match_units(spark, sf_dir):
    """Documents as match units: every third one by its first two sentences, every fifth one degraded and left out."""
    d = table(spark, sf_dir, "documents").withColumn("global_id", F.concat(F.lit("g"), F.col("doc_id").cast("string")))
    part = lambda i: F.struct(F.lit(i).alias("index"), F.split_part("text", F.lit(". "), F.lit(i)).alias("content"), F.lit(None).cast("string").alias("conclusion"))
    nodes = d.select("doc_id", F.lit(0).alias("pos"), "global_id", F.col("text").alias("content"), (F.col("doc_id") % 5 == 0).alias("degraded"), F.when(F.col("doc_id") % 3 == 0, F.array(part(1), part(2))).alias("sub_nodes"))
    return N.match_units(nodes).select("doc_id", "parent", "unit", "text")


VERDICTS = Sample("verdicts", {"key": "int", "verdict": "string", "level": "string", "evidence": "array<string>", "missing_premise": "boolean", "excluded": "boolean"}, [
    (1, "accepted", "explicit", ["a"], False, False), (2, "accepted", "indirect", ["a"], False, False), (3, "accepted", "direct", [], False, False), (4, "review", "indirect", ["x"], False, False), (5, "review", "direct", ["x"], False, False),
    (6, "maybe", "direct", ["x"], False, False), (7, None, None, None, None, None), (8, "accepted", "direct", ["x"], True, False), (9, "accepted", "direct", ["x"], None, True), (10, "rejected", None, None, True, True),
])


@query(f"""WITH {VERDICTS.sql}, r AS (SELECT key, verdict, CASE WHEN verdict IS NULL OR verdict NOT IN ('accepted', 'review', 'rejected') THEN 'unknown_verdict' WHEN verdict = 'rejected' THEN NULL WHEN coalesce(len(evidence), 0) = 0 THEN 'no_evidence'
    WHEN verdict = 'accepted' AND coalesce(level, '') NOT IN ('explicit', 'direct') THEN 'level_too_weak' WHEN verdict = 'review' AND coalesce(level, '') <> 'indirect' THEN 'level_not_indirect' WHEN missing_premise THEN 'missing_premise' WHEN excluded THEN 'excluded' END AS guard_reason FROM verdicts)
    SELECT key, CASE WHEN guard_reason IS NOT NULL THEN 'rejected' ELSE verdict END AS verdict, guard_reason FROM r""")
def verdict_guards(spark, sf_dir):
    """Verdicts partitioned into accepted, review and rejected by their guards."""
    return N.judged_verdicts(VERDICTS.frame(spark)).select("key", "verdict", "guard_reason")


@query("""WITH d AS (SELECT doc_id, text, CASE quality WHEN 1 THEN 'keep' WHEN 0 THEN 'quarantine' END AS a FROM documents LEFT JOIN labels USING (doc_id))
    SELECT doc_id, CASE WHEN a IN ('keep', 'clean', 'quarantine') THEN CASE WHEN a = 'quarantine' AND regexp_matches(coalesce(text, ''), '[$=<>∀∃∈≤≥→⇒]|\\\\[A-Za-z]+|\\d\\s*[+*/^-]\\s*\\d') THEN 'manual_review' ELSE a END ELSE 'manual_review' END AS action FROM d""")
def cleaning_actions(spark, sf_dir):
    """Cleaning decisions on documents: what would be quarantined although it shows mathematics is reviewed by hand."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    told = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.when(F.col("quality") == 1, "keep").when(F.col("quality") == 0, "quarantine").alias("action"))
    return N.cleaning_decisions(d, told).select(F.col("key").alias("doc_id"), "action")


# Vectors.


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings), c AS (SELECT * FROM q WHERE k <= 2), r AS (SELECT * FROM q WHERE k BETWEEN 3 AND 5),
    p AS (SELECT c.label, c.vec_id AS x, max(list_cosine_similarity(a.e, b.e)) AS best FROM c JOIN r ON c.label = r.label JOIN v a ON a.vec_id = c.vec_id JOIN v b ON b.vec_id = r.vec_id GROUP BY ALL)
    SELECT label, round(avg(best), 6) AS coverage, round(avg(CASE WHEN best > 0.7 THEN 1 ELSE 0 END), 6) AS over_threshold FROM p GROUP BY ALL""")
def condition_coverage(spark, sf_dir):
    """How far the first two vectors of each label are covered by the next three: mean best similarity, and the share over 0.7."""
    e = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), 1, 5), lambda x: x["embedding"]).alias("v"))
    a, b = F.slice("v", 1, 2), F.slice("v", 3, 3)
    rows = e.where("size(v) > 2").select("label", F.round(V.coverage(a, b, T.cosine), 6).alias("coverage"), F.round(V.threshold_coverage(a, b, T.cosine, 0.7), 6).alias("over_threshold"))
    return rows


VECTORS = Sample("vecs", {"id": "int", "a": "array<double>", "b": "array<double>"}, [(1, [1.0, 0.0], [1.0, 1.0]), (2, [0.0, 0.0], [1.0, 1.0]), (3, [2.0, -1.0], [-2.0, 1.0]), (4, [0.5], [0.25])])


@query(f"WITH {VECTORS.sql} SELECT id, round(CASE WHEN list_sum(list_transform(a, lambda x: abs(x))) = 0 OR list_sum(list_transform(b, lambda x: abs(x))) = 0 THEN 'NaN'::DOUBLE ELSE list_inner_product(a, b) / sqrt(list_inner_product(a, a)) / sqrt(list_inner_product(b, b)) END, 9) AS cosine FROM vecs")
def raw_cosines(spark, sf_dir):
    """Cosine that is not a number for a zero vector."""
    return VECTORS.frame(spark).select("id", F.round(T.raw_cosine(F.col("a"), F.col("b")), 9).alias("cosine"))


@query("SELECT sha256('model-1' || chr(0) || lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS key, min(doc_id) AS first_doc, count(*) AS uses FROM documents WHERE trim(text) <> '' GROUP BY ALL HAVING count(*) FILTER (doc_id < 50) = 0")
def embedding_misses(spark, sf_dir):
    """Distinct texts that a cache, of the documents before the fiftieth, has no vector for."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    cached = V.embedding_keys(d.where("doc_id < 50"), "model-1").select("key", F.array(F.lit(1.0)).alias("vector"))
    return V.embedding_misses(V.embedding_keys(d, "model-1"), cached).select("key", "first_doc", "uses")


# Reranking.


@query("""WITH c AS (SELECT l_orderkey AS doc_id, l_orderkey AS dependent, l_suppkey AS support, CASE WHEN l_linestatus = 'F' THEN 'definition' ELSE 'logic' END AS kind, l_orderkey || '-' || l_linenumber AS candidate_id, l_discount + l_linenumber / 1000 AS rrf FROM lineitem),
    p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, dependent, kind ORDER BY round(rrf, 9) DESC, support) AS p FROM c)
    SELECT doc_id, kind, (p - 1) // 3 AS batch, sha256('["' || string_agg(candidate_id, '","' ORDER BY p) || '"]') AS fingerprint FROM p GROUP BY doc_id, kind, batch""")
def rerank_batches(spark, sf_dir):
    """Candidates in batches of three by score, with the key under which an answer is kept."""
    i = table(spark, sf_dir, "lineitem")
    c = i.select(F.col("l_orderkey").alias("doc_id"), F.col("l_orderkey").alias("dependent"), F.col("l_suppkey").alias("support"), F.when(F.col("l_linestatus") == "F", "definition").otherwise("logic").alias("kind"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("candidate_id"), (F.col("l_discount") + F.col("l_linenumber") / 1000).alias("rrf"))
    return V.rerank_tasks(c, 3).select("doc_id", "kind", "batch", "fingerprint")


@query("""WITH c AS (SELECT l_orderkey AS doc_id, l_suppkey AS support, l_linestatus AS kind, l_orderkey || '-' || l_linenumber AS candidate_id, l_discount AS rrf, l_linenumber % 4 AS rerank_score FROM lineitem)
    SELECT candidate_id, rerank_score::DOUBLE AS rerank_score, row_number() OVER (PARTITION BY doc_id, kind ORDER BY rerank_score DESC, round(rrf, 9) DESC, support, candidate_id) AS rerank_rank FROM c""")
def rerank_applied(spark, sf_dir):
    """Candidates with the scores of a table-backed reranker and their rank by it."""
    i = table(spark, sf_dir, "lineitem")
    c = i.select(F.col("l_orderkey").alias("doc_id"), F.col("l_orderkey").alias("dependent"), F.struct(F.col("l_suppkey"), F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("support"), F.col("l_linestatus").alias("kind"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("candidate_id"), F.col("l_discount").alias("rrf"))
    scores = i.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("candidate_id"), (F.col("l_linenumber") % 4).alias("rerank_score"))
    return V.reranked(c, scores).select("candidate_id", "rerank_score", "rerank_rank")


@query("""WITH t AS (SELECT conv_id AS key, list(turn ORDER BY turn) AS ids FROM conversations GROUP BY ALL), a AS (SELECT conv_id AS key, list(turn ORDER BY turn DESC) AS ids, list(length(text) % 5 ORDER BY turn DESC)::INT[] AS scores FROM conversations WHERE conv_id % 7 <> 0 GROUP BY ALL)
    SELECT t.key, coalesce(list_sort(t.ids) = list_sort(a.ids) AND len(list_filter(a.scores, lambda s: s > 3)) = 0, false) AS ok FROM t LEFT JOIN a USING (key)""")
def answer_checks(spark, sf_dir):
    """Answers whose ids are those asked and whose scores lie within 0 and 3; a missing answer fails."""
    c = table(spark, sf_dir, "conversations")
    tasks = c.groupBy(F.col("conv_id").alias("key")).agg(F.collect_list("turn").alias("ids"))
    answers = c.where("conv_id % 7 <> 0").groupBy(F.col("conv_id").alias("key")).agg(F.collect_list(F.struct(F.col("turn").alias("t"), (F.length("text") % 5).alias("s"))).alias("r"))
    return stages.validated_answers(tasks, answers.select("key", F.col("r.t").alias("ids"), F.col("r.s").alias("scores")))


# Models and calls.


@query("""WITH c AS (SELECT event_type AS model, user_id % 5 <> 0 AS ok, abs(value) AS seconds FROM events), p AS (SELECT model, count(*) AS n, avg(ok::INT) AS success, max(seconds) FILTER (ok) AS longest,
    list_sort(list(seconds) FILTER (ok)) AS s FROM c GROUP BY ALL) SELECT model, n, round(success, 9) AS success, round(s[len(s) // 2 + 1], 9) AS median, round(longest, 9) AS longest FROM p""")
def model_probe(spark, sf_dir):
    """Calls, success rate, upper median and longest time of each model."""
    calls = table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), (F.col("user_id") % 5 != 0).alias("ok"), F.abs("value").alias("seconds"))
    got = R.probe_summary(calls)
    return got.select("model", "n", *[F.round(c, 9).alias(c) for c in ("success", "median", "longest")])


@query("WITH m AS (SELECT event_type AS model, count(*)::DOUBLE / 60 AS rps, avg((user_id % 5 <> 0)::INT) AS success FROM events GROUP BY ALL) SELECT model, round(0.6 * rps / (SELECT max(rps) FROM m) + 0.4 * success, 9) AS score FROM m")
def model_ranking(spark, sf_dir):
    """Models by a weighted sum of rate and success."""
    m = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("model")).agg((F.count("*").cast("double") / 60).alias("rps"), F.avg((F.col("user_id") % 5 != 0).cast("int")).alias("success"))
    return R.model_scores(m).select("model", F.round("score", 9).alias("score"))


@query("""SELECT coalesce(a.k, b.k) AS key, coalesce(a.v, []) AS left_values, coalesce(b.v, []) AS right_values FROM (SELECT n_regionkey AS k, list_sort(list(n_name)) AS v FROM nation WHERE n_regionkey < 4 GROUP BY ALL) a
    FULL JOIN (SELECT r_regionkey AS k, list_sort(list(r_name)) AS v FROM region WHERE r_regionkey > 0 GROUP BY ALL) b ON a.k = b.k""")
def grouped_sides(spark, sf_dir):
    """Nations and regions by region, each side's list empty where it has none."""
    n = table(spark, sf_dir, "nation").where("n_regionkey < 4").select(F.col("n_regionkey").alias("key"), F.col("n_name").alias("value"))
    r = table(spark, sf_dir, "region").where("r_regionkey > 0").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("value"))
    return R.grouped_sides(n, r, "key", "value")


@query("SELECT name, string_agg(p_partkey || ':' || p_type, '|' ORDER BY p_partkey) AS uses FROM (SELECT p_partkey, p_type, unnest(string_split(p_name, ' ')) AS name FROM part) GROUP BY ALL")
def inverted_names(spark, sf_dir):
    """Each word of part names with the parts that use it, in order."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.split("p_name", " ").alias("names"), F.col("p_type").alias("explanation"))
    return R.inverted(p).select("name", F.array_join(F.transform("uses", lambda u: F.concat_ws(":", u["pos"].cast("string"), u["explanation"])), "|").alias("uses"))


@query("SELECT DISTINCT CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size = 1) THEN 'small brand' ELSE p_brand END AS name, p_size AS size FROM part")
def canonical_names(spark, sf_dir):
    """Distinct brands and sizes with synonyms replaced by one name."""
    p = table(spark, sf_dir, "part")
    synonyms = p.where("p_size = 1").select(F.col("p_brand").alias("name"), F.lit("small brand").alias("canonical"))
    return R.canonical(p.select(F.col("p_brand").alias("name"), F.col("p_size").alias("size")), synonyms, "name")


# Accounts, queues, corrections.

SESSIONS = Sample("sessions_", {"user_id": "int", "token_hash": "string", "revoked": "boolean", "expires": "int"}, [(1, "a", False, 10), (2, "b", True, 10), (3, "c", False, 1), (4, "d", False, 10), (1, "e", False, 99)])


@query(f"WITH {SESSIONS.sql} SELECT token_hash, user_id FROM sessions_ WHERE NOT revoked AND expires > 5 AND user_id <> 4 AND token_hash IN ('a', 'b', 'c', 'd', 'zz')")
def session_lookup(spark, sf_dir):
    """The session of each asked token: not revoked, not expired, of an active user."""
    users = spark.range(6).select(F.col("id").cast("int").alias("user_id"), (F.col("id") != 4).alias("active"))
    s = SESSIONS.frame(spark).select("user_id", "token_hash", F.when(F.col("revoked"), F.lit(1)).alias("revoked_at"), F.col("expires").alias("expires_at"))
    out = None
    for token in ("a", "b", "c", "d", "zz"):
        row = E.active_session(users, s, token, F.lit(5)).select("token_hash", "user_id")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT o_orderkey AS id, o_totalprice AS total FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus <> 'F') UNION ALL SELECT NULL::BIGINT, NULL::DOUBLE WHERE false")
def owned_lookup(spark, sf_dir):
    """One undeleted row by key for its owner; for a stranger, and for a deleted row, nothing."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), F.col("o_totalprice").alias("total"), F.when(F.col("o_orderstatus") == "F", F.lit(1)).alias("deleted_at"))
    one = o.where("deleted_at is null").agg(F.min(F.struct("id", "owner"))).first()[0]
    gone = o.where("deleted_at is not null").agg(F.min(F.struct("id", "owner"))).first()[0]
    return A.owned(o, "id", one.id, one.owner).unionByName(A.owned(o, "id", one.id, -1)).unionByName(A.owned(o, "id", gone.id, gone.owner)).select("id", "total")


QUEUE = Sample("queue_", {"idempotency_key": "string", "operation": "string"}, [("k1", "delete"), ("k2", "upload"), (None, "old")])


@query(f"WITH {QUEUE.sql} SELECT idempotency_key, operation FROM queue_ UNION ALL SELECT 'k3', 'delete' UNION ALL SELECT 'k4', 'a'")
def idempotent_enqueue(spark, sf_dir):
    """A queue with entries added once per key."""
    rows = spark.createDataFrame([("k1", "again"), ("k3", "delete"), ("k4", "b"), ("k4", "a"), (None, "no key")], "idempotency_key string, operation string")
    return A.enqueued(QUEUE.frame(spark), rows)


@query("SELECT c_custkey AS row, 'name' AS field, c_name AS value FROM customer WHERE lower(c_name) IN (SELECT lower(c_name) FROM customer WHERE c_custkey < 5) UNION ALL SELECT c_custkey, 'segment', c_mktsegment FROM customer WHERE c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_custkey < 5)")
def import_conflicts(spark, sf_dir):
    """Records to import whose name or segment is taken by the first users."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row"), F.upper("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    users = c.where("row < 5").select(F.lower("name").alias("name"), "segment")
    plain = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return A.import_conflicts(plain, users, ("name", "segment"))


@query("SELECT n_nationkey AS user_id, n_regionkey AS workspace, CASE WHEN n_nationkey < 5 THEN 'dark' WHEN n_nationkey < 7 THEN 'last' ELSE n_name END AS setting FROM nation UNION ALL SELECT 99, 0, 'new'")
def settings_upsert(spark, sf_dir):
    """Settings upserted on a key of two columns; of several new rows of a key the last counts."""
    s = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("user_id"), F.col("n_regionkey").cast("int").alias("workspace"), F.col("n_name").alias("setting"))
    new = s.where("user_id < 5").select("user_id", "workspace", F.lit("dark").alias("setting"), F.lit(1).alias("seq"))
    new = new.unionByName(s.where("user_id in (5, 6)").select("user_id", "workspace", F.explode(F.array(F.struct(F.lit("first").alias("v"), F.lit(1).alias("seq")), F.struct(F.lit("last").alias("v"), F.lit(2).alias("seq")))).alias("r")).select("user_id", "workspace", F.col("r.v").alias("setting"), "r.seq"))
    new = new.unionByName(spark.createDataFrame([(99, 0, "new", 1)], "user_id int, workspace int, setting string, seq int"))
    return A.upserted(s, new, ["user_id", "workspace"], "seq")


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'paused' ELSE event_type END AS status, CASE WHEN user_id % 3 = 0 THEN CASE WHEN user_id % 2 = 0 THEN -1 ELSE user_id END ELSE event_id END AS updated_at FROM events")
def state_repair(spark, sf_dir):
    """States after a restart: running ones paused, missing times filled from the creation or from now."""
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", F.when(F.col("event_type") == "click", "running").otherwise(F.col("event_type")).alias("status"), F.when(F.col("user_id") % 2 != 0, F.col("user_id")).alias("created_at"), F.when(F.col("user_id") % 3 != 0, F.col("event_id")).alias("updated_at"))
    return A.repaired_states(rows, F.lit(-1).cast("long")).select("event_id", "status", "updated_at")


_CORRECTED = """u AS (SELECT conv_id AS doc_id, (turn // 2)::INT AS batch, turn, text FROM conversations), b AS (SELECT doc_id, batch, count(*) AS n, min(length(trim(text))) AS shortest FROM u GROUP BY ALL),
    c AS (SELECT u.*, CASE WHEN u.doc_id % 3 = 0 AND u.batch = 0 THEN 'fallback' WHEN u.doc_id % 5 = 1 AND n > 1 THEN 'fallback' WHEN shortest = 0 THEN 'fallback' WHEN u.doc_id % 2 = 0 THEN 'changed' ELSE 'same' END AS state FROM u JOIN b USING (doc_id, batch))"""


def _corrected(spark, sf_dir):
    u = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.floor(F.col("turn") / 2).cast("int").alias("batch"), F.col("turn").alias("pos"), F.col("turn").alias("unit"), "text")
    shown = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    answers = u.where("not (doc_id % 3 = 0 and batch = 0)").groupBy("doc_id", "batch").agg(F.array_sort(F.collect_list(F.struct("unit", shown.alias("t")))).alias("r"))
    r = F.when(F.col("doc_id") % 5 == 1, F.reverse("r")).otherwise(F.col("r"))
    return A.accepted_corrections(u, answers.withColumn("r", r).select("doc_id", "batch", F.col("r.unit").alias("ids"), F.col("r.t").alias("texts")))


@query(f"WITH {_CORRECTED} SELECT doc_id, turn, state, CASE WHEN state = 'changed' THEN text || '!' ELSE text END AS final FROM c")
def corrected_units(spark, sf_dir):
    """Turns corrected by batches: answers that lack a batch, or have its units in another order, fall back to the source."""
    return _corrected(spark, sf_dir).select("doc_id", F.col("pos").alias("turn"), "state", "final")


@query(f"WITH {_CORRECTED} SELECT doc_id, count(*) AS units, count(*) FILTER (state = 'changed') AS changed, count(*) FILTER (state = 'fallback') AS fallback, round(count(*) FILTER (state = 'fallback') / count(*), 9) AS ratio, count(*) FILTER (state = 'fallback') / count(*) <= 0.3 AS passed FROM c GROUP BY ALL")
def correction_report(spark, sf_dir):
    """Changed and fallen back units of each conversation and whether few enough fell back."""
    return A.correction_report(_corrected(spark, sf_dir)).withColumn("ratio", F.round("ratio", 9))


@query("""WITH x AS (SELECT user_id AS key, event_id % 4 AS round, event_type <> 'click' AS ok FROM events), e AS (SELECT DISTINCT key FROM x), f AS (SELECT key, min(round) AS done_in FROM x WHERE ok GROUP BY ALL)
    SELECT round, (SELECT count(*) FROM f WHERE done_in <= r.round) AS done, (SELECT count(*) FROM e) AS expected, round((SELECT count(*) FROM f WHERE done_in <= r.round) / (SELECT count(*) FROM e), 9) AS share,
    (SELECT count(*) FROM f WHERE done_in <= r.round) / (SELECT count(*) FROM e) < 0.9 AS again FROM (SELECT DISTINCT round FROM x) r""")
def completion_rounds(spark, sf_dir):
    """Tasks done after each round, and whether another is needed."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.col("event_id") % 4).alias("round"), (F.col("event_type") != "click").alias("ok"))
    return A.completed(e, e.select("key")).withColumn("share", F.round("share", 9))


TITLES = Sample("titles_", {"doc_id": "int", "pos": "int", "title": "string"}, [(1, 0, "Mean value"), (1, 1, "Sets"), (1, 2, "Sets"), (1, 5, "Late title"), (2, 0, "Mean"), (2, 1, "value theorem of Mean")])
ASKED = Sample("asked_", {"doc_id": "int", "pos": "int", "hit": "int", "surface": "string"}, [(1, 3, 0, "the Mean value theorem"), (1, 3, 1, "Sets"), (1, 4, 0, "Late title"), (2, 3, 0, "value theorem"), (2, 0, 0, "Mean"), (3, 1, 0, "Mean value")])


@query(f"WITH {TITLES.sql}, {ASKED.sql}, o AS (SELECT doc_id, title, min(pos) AS pl FROM titles_ GROUP BY ALL HAVING count(*) = 1) SELECT a.doc_id, a.pos, a.hit, min(o.pl) AS target FROM asked_ a JOIN o USING (doc_id) WHERE o.pl < a.pos AND (contains(a.surface, o.title) OR contains(o.title, a.surface)) GROUP BY ALL")
def title_fallbacks(spark, sf_dir):
    """References resolved by a title that occurs once, earlier, one within the other."""
    return E.title_fallback(ASKED.frame(spark), TITLES.frame(spark))


SPANS = Sample("spans_", {"child": "int", "parent": "int"}, [(1, 10), (2, 11), (3, None), (4, 99), (5, 98), (6, 10)])


@query(f"WITH {SPANS.sql} SELECT 'orphan' AS problem, parent AS key FROM spans_ WHERE parent > 50 UNION ALL SELECT 'missing', 98 UNION ALL SELECT 'missing', 99 UNION ALL SELECT 'unreferenced', 12")
def orphans_and_versions(spark, sf_dir):
    """Children without their parent, and versions that are missing or that nothing refers to."""
    rows = SPANS.frame(spark)
    parents = spark.range(10, 13).select(F.col("id").cast("int").alias("id"))
    a = R.orphans(rows, parents, "parent", "id").select(F.lit("orphan").alias("problem"), F.col("parent").alias("key"))
    b = R.reconciled(rows.where("parent is not null").select(F.col("parent").alias("key")), parents.select(F.col("id").alias("key")), "key")
    return a.unionByName(b.select(F.when(F.col("state") == "orphan", "unreferenced").otherwise(F.col("state")).alias("problem"), "key"))


@query("""WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY ALL), s AS (SELECT DISTINCT conv_id, turn, unnest(string_split(lower(text), ' ')) AS token FROM conversations),
    d AS (SELECT conv_id, token, count(*) AS df, any_value(n) AS n FROM s JOIN n USING (conv_id) WHERE token <> '' GROUP BY ALL HAVING count(*) <= greatest(3, ceil(any_value(n) * 0.2)))
    SELECT a.conv_id AS doc_id, a.turn AS dependent, b.turn AS support, round(sum(ln(1 + n / df)), 6) AS score FROM s a JOIN d USING (conv_id, token) JOIN s b ON a.conv_id = b.conv_id AND a.token = b.token AND b.turn < a.turn GROUP BY ALL""")
def symbol_idf_scores(spark, sf_dir):
    """Sums of ln(1 + N / df) over the rare words that two turns of a conversation share."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("unit"), "text")
    symbols = c.select("doc_id", "unit", F.explode(F.split(F.lower("text"), " ")).alias("symbol")).where("symbol <> ''").distinct()
    return V.shared_symbol_scores(symbols, c).withColumn("score", F.round("score", 6))


# Predicate groups and the registry.

USES = Sample("uses_", {"pos": "int", "predicate": "string", "name": "string", "arity": "int", "sorts": "array<string>", "template": "string", "gloss": "string"}, [
    (0, "IsPrime", "isPrime", 1, ["Int"], "{Int} is prime", "a whole number without divisors"), (1, "Prime", "is_prime", 1, ["Entity"], "{Int} is a prime", "number without proper divisors"), (2, "Divides", "divides", 2, ["Int", "Int"], "{Int} divides {Int}", "a divisor of"),
    (3, "DividesOf", "divides", 2, ["Int", "Entity"], "{A} divides {B}", "is a divisor of"), (4, "Divides", "DIVIDES", 2, ["Set", "Int"], "x", "none"), (5, "SubsetOf", "subset", 2, ["Set", "Set"], "{Set} within {Set}", "is contained in"), (6, "Contains", "within", 2, ["Set", "Set"], "{Set} within {Set}", "contains"), (7, "Lone", "lone", 1, ["Set"], "", None),
])
_BAG = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^a-z0-9{{}}]+'), lambda w: w <> ''))"
_SNAKE_OF = _SNAKE.replace("coalesce(name, '')", "coalesce(predicate, '')")
_PAIRS = f"""{USES.sql}, ue AS (SELECT pos, arity, sorts, {_SNAKE_OF} AS sk, upper(regexp_replace(coalesce(name, ''), '[^A-Za-z0-9]+', '', 'g')) AS nk, {_BAG.format(c="template")} AS tw, {_BAG.format(c="gloss")} AS gw FROM uses_),
    uj AS (SELECT a.pos AS x, b.pos AS y, (a.sk = b.sk)::INT AS s, (a.nk = b.nk)::INT AS n, CASE WHEN len(a.tw) = 0 OR len(b.tw) = 0 THEN 0 ELSE len(list_intersect(a.tw, b.tw)) / len(list_distinct(list_concat(a.tw, b.tw))) END AS t,
    CASE WHEN len(a.gw) = 0 OR len(b.gw) = 0 THEN 0 ELSE len(list_intersect(a.gw, b.gw)) / len(list_distinct(list_concat(a.gw, b.gw))) END AS g FROM ue a JOIN ue b ON a.pos < b.pos AND a.arity = b.arity AND len(a.sorts) = len(b.sorts)
    AND len(list_filter(range(1, len(a.sorts) + 1), lambda i: NOT (a.sorts[i] = b.sorts[i] OR a.sorts[i] = 'Entity' OR b.sorts[i] = 'Entity'))) = 0),
    up AS (SELECT x, y, round(least(0.45 * s + 0.25 * n + 0.2 * t + 0.1 * g, 1), 4) AS score FROM uj WHERE s > 0 OR n > 0 OR t >= 0.5 OR g >= 0.5)"""


@query(f"WITH {_PAIRS} SELECT x, y, score FROM up")
def predicate_pairs(spark, sf_dir):
    """Uses that may name one predicate, with the score of what they share."""
    return P.candidate_pairs(USES.frame(spark))


@query(f"""WITH RECURSIVE {_PAIRS}, ul AS (SELECT x, y FROM up UNION ALL SELECT y, x FROM up), ur AS (SELECT DISTINCT x AS id, x AS other FROM ul UNION SELECT ur.id, ul.y FROM ur JOIN ul ON ul.x = ur.other), uc AS (SELECT id, min(other) AS c FROM ur GROUP BY id),
    ug AS (SELECT c, count(*) AS size, list_sort(list(id)) AS members FROM uc GROUP BY c), ub AS (SELECT c, max(score) AS most FROM up JOIN uc ON uc.id = up.x GROUP BY c)
    SELECT row_number() OVER (ORDER BY size DESC, most DESC, c) AS "group", size, most, members FROM ug JOIN ub USING (c)""")
def predicate_groups(spark, sf_dir):
    """Groups of such uses, larger and surer ones first."""
    return P.candidate_groups(P.candidate_pairs(USES.frame(spark)))


@query(f"""WITH {USES.sql}, k AS (SELECT *, arity AS cluster FROM uses_), c AS (SELECT cluster, name, count(*) AS n, min(pos) AS pl FROM k GROUP BY ALL), b AS (SELECT cluster, arg_max(name, n * 1000 - pl) AS name FROM c GROUP BY ALL)
    SELECT k.cluster, b.name, list_sort(list(DISTINCT k.name)) AS names, count(DISTINCT k.template) AS templates FROM k JOIN b USING (cluster) GROUP BY k.cluster, b.name""")
def predicate_registry(spark, sf_dir):
    """The registry of predicates by cluster: the most common name, the first on ties, and all names."""
    r = P.registry(USES.frame(spark).withColumn("cluster", F.col("arity")))
    return r.select("cluster", "name", "names", F.size("templates").cast("long").alias("templates"))


@query(f"WITH {USES.sql} SELECT arity, list_sort(list(DISTINCT name)) AS names, count(*) AS merged FROM uses_ GROUP BY arity")
def merged_registry(spark, sf_dir):
    """Registry entries of one key, arity and sorts merged with all their names."""
    rows = USES.frame(spark).select(F.lit("P_X").alias("key"), "arity", F.array(F.lit("Set")).alias("sorts"), F.array("name").alias("names"), F.array("template").alias("templates"))
    return P.merged_registry(rows).select("arity", "names", "merged")


@query("""WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber AS dependent, l_linenumber - 1 AS support, CASE WHEN l_linestatus = 'F' THEN 'definition' ELSE 'logic' END AS kind, l_discount AS rrf, l_suppkey, l_partkey FROM lineitem),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY round(rrf, 9) DESC, l_suppkey * 1000000 + l_partkey) AS k FROM c)
    SELECT doc_id, kind, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(rrf, 9) DESC, l_suppkey * 1000000 + l_partkey) AS p FROM k WHERE kind <> 'definition' OR k <= 1) WHERE p <= 3 GROUP BY ALL""")
def parent_group_cap(spark, sf_dir):
    """The cap before reranking per parent group: three in all, one definition."""
    i = table(spark, sf_dir, "lineitem")
    c = i.select(F.col("l_orderkey").alias("doc_id"), F.lit("p").alias("parent"), F.lit(0).alias("dependent"), (-(F.col("l_suppkey") * 1_000_000 + F.col("l_partkey"))).alias("support"), F.when(F.col("l_linestatus") == "F", "definition").otherwise("logic").alias("kind"), F.lit(False).alias("alias"), F.lit(False).alias("protected"), F.col("l_discount").alias("rrf"))
    return V.capped(c, 3, 1, per="parent").groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


NODES_SEALED = Sample("sealed_", {"id": "int", "node_type": "string", "source_original_form": "string", "content": "string"}, [(1, "theorem", "Let  x", "other"), (2, "definition", None, "A  set\tof"), (3, "定理", "设 x", None), (4, "example", "  ", "see below"), (5, "definition", "given", "content")])


@query(f"WITH {NODES_SEALED.sql}, s AS (SELECT id, CASE WHEN node_type IN ('theorem', '定理') THEN source_original_form WHEN trim(coalesce(source_original_form, '')) <> '' THEN source_original_form ELSE content END AS src FROM sealed_) SELECT id, md5(trim(regexp_replace(coalesce(src, ''), '\\s+', ' ', 'g'))) AS global_id, sha256(coalesce(src, '')) AS source_sha256 FROM s")
def sealed_nodes(spark, sf_dir):
    """Global id and digest of the source text of nodes."""
    return N.sealed(NODES_SEALED.frame(spark)).select("id", "global_id", "source_sha256")
