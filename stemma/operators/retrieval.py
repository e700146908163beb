"""Candidate retrieval over ordered units: token statistics, BM25F, channels, rank fusion, budgets, evaluation.

Units are (doc_id, pos, ...): pos orders the units of a document, and a unit's candidates are earlier units of the same
document, so every join is partitioned by document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.plans.state import placed

RRF_K = 60


def weighted_bag(fields: DataFrame) -> DataFrame:
    """fields(doc_id, pos, tokens array, weight) -> (doc_id, pos, token, tf): weights summed over fields."""
    return fields.select("doc_id", "pos", F.explode("tokens").alias("token"), "weight").groupBy("doc_id", "pos", "token").agg(F.sum("weight").alias("tf"))


def document_statistics(units: DataFrame, bag: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per document: units and their average length (at least 1); per unit its length; per token its frequency."""
    lengths = bag.groupBy("doc_id", "pos").agg(F.sum("tf").alias("length"))
    sizes = units.select("doc_id", "pos").join(lengths, ["doc_id", "pos"], "left").groupBy("doc_id").agg(F.greatest(F.count("*"), F.lit(1)).alias("n"), F.greatest(F.coalesce(F.sum("length"), F.lit(0)) / F.count("*"), F.lit(1.0)).alias("average"))
    frequency = bag.groupBy("doc_id", "token").agg(F.count("*").alias("df"))
    return sizes, lengths, frequency


def idf(n: Column, df: Column) -> Column:
    """Inverse document frequency, never negative."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_postings(units: DataFrame, bag: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(doc_id, pos, token, w): what the token adds to the unit's score for a query that has it."""
    sizes, lengths, frequency = document_statistics(units, bag)
    rows = bag.join(lengths, ["doc_id", "pos"]).join(frequency, ["doc_id", "token"]).join(sizes, "doc_id")
    weight = idf(F.col("n"), F.col("df")) * (F.col("tf") * (k1 + 1)) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("average")))
    return rows.select("doc_id", "pos", "token", weight.alias("w"))


def predecessor_scores(queries: DataFrame, postings: DataFrame) -> DataFrame:
    """queries(doc_id, pos, token), postings -> (doc_id, dependent, support, score) for each earlier unit with a token in
    common: distinct query tokens, scores summed."""
    q = queries.select("doc_id", F.col("pos").alias("dependent"), "token").distinct()
    p = postings.select("doc_id", F.col("pos").alias("support"), "token", "w")
    joined = q.join(p, ["doc_id", "token"]).where(F.col("support") < F.col("dependent"))
    return joined.groupBy("doc_id", "dependent", "support").agg(F.sum("w").alias("score"))


def ranked(scores: DataFrame, limit: int, by: tuple[str, ...] = ("doc_id", "dependent")) -> DataFrame:
    """The best `limit` supports of each dependent, scores to nine decimals, ties to the earlier support."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("score", 9)), "support")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def local_window(units: DataFrame, limit: int = 8) -> DataFrame:
    """The last `limit` earlier units of each, scored by the inverse of their distance: one sequence, no self-join."""
    place = units.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")))
    back = F.collect_list(F.struct("pos", "seq")).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-limit, -1))
    near = place.withColumn("near", back).select("doc_id", F.col("pos").alias("dependent"), F.col("seq").alias("at"), F.explode("near").alias("p"))
    return near.select("doc_id", "dependent", F.col("p.pos").alias("support"), (1 / (F.col("at") - F.col("p.seq"))).alias("score"), (F.col("at") - F.col("p.seq")).cast("int").alias("rank"))


def implicit_pairs(pairs: DataFrame, units: DataFrame, excluded: DataFrame) -> DataFrame:
    """pairs(doc_id, dependent, support, ...), units(doc_id, pos, parent, definition, statement), excluded(doc_id,
    dependent_parent, support_parent) -> the pairs that may be implicit relations, a row per kind: the support comes
    earlier and has another parent (units without one differ from all), the parents are no excluded pair, and the
    support is a definition (kind definition), or both are statements (kind logic)."""
    d, s = (units.select("doc_id", F.col("pos").alias(c), F.coalesce("parent", F.lit("")).alias(f"{c}_parent"), F.col("definition").alias(f"_{c}_d"), F.col("statement").alias(f"_{c}_s")) for c in ("dependent", "support"))
    rows = pairs.where(F.col("support") < F.col("dependent")).join(d, ["doc_id", "dependent"]).join(s, ["doc_id", "support"])
    rows = rows.where((F.col("dependent_parent") == "") | (F.col("dependent_parent") != F.col("support_parent")))
    gone = excluded.select("doc_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("dependent_parent", "support_parent")]).distinct()
    kinds = F.array_compact(F.array(F.when(F.col("_support_d"), "definition"), F.when(F.col("_support_s") & F.col("_dependent_s"), "logic")))
    return rows.join(gone, ["doc_id", "dependent_parent", "support_parent"], "left_anti").select(*pairs.columns, F.explode(kinds).alias("kind"))


def implicit_window(units: DataFrame, excluded: DataFrame, limit: int = 8) -> DataFrame:
    """The last `limit` earlier units of each that may be its logic support, see implicit_pairs, scored by the inverse of
    their distance in units; rank counts eligible ones only."""
    place = units.select("doc_id", "pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")).alias("seq"))
    a, b = place.toDF("doc_id", "dependent", "at"), place.toDF("doc_id", "support", "seq")
    pairs = a.join(b, "doc_id").where(F.col("support") < F.col("dependent"))
    fit = implicit_pairs(pairs, units, excluded).where("kind = 'logic'")
    ranked_back = fit.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "dependent").orderBy(F.desc("seq")))).where(F.col("rank") <= limit)
    return ranked_back.select("doc_id", "dependent", "support", "kind", (1 / (F.col("at") - F.col("seq"))).alias("score"), "rank")


def rare_tokens(sizes: DataFrame, frequency: DataFrame) -> DataFrame:
    """Tokens that occur in at most max(3, a fifth) of a document's units."""
    return frequency.join(sizes, "doc_id").where(F.col("df") <= F.greatest(F.lit(3), F.ceil(F.col("n") * 0.2))).select("doc_id", "token", "df")


def fused(channels: DataFrame, k: int = RRF_K, protect: int = 2, by: tuple[str, ...] = ("doc_id", "dependent", "support")) -> DataFrame:
    """channels(doc_id, dependent, support, channel, rank) -> reciprocal-rank fusion, the channels, and whether the pair
    is among a channel's first `protect`; by may add the kind."""
    return channels.groupBy(*by).agg(F.sum(1 / (k + F.col("rank"))).alias("rrf"), F.array_sort(F.collect_set("channel")).alias("channels"), (F.min("rank") <= protect).alias("protected"))


def capped(candidates: DataFrame, total: int = 80, definitions: int = 40, per: str = "dependent") -> DataFrame:
    """candidates(doc_id, dependent, support, kind, alias, protected, rrf): at most so many per dependent (or per any other
    column, such as the dependent's parent), in order of alias hit, protection, fusion score, distance, id. Definitions
    over their own cap are passed by, they use up nothing."""
    order = [F.desc("alias"), F.desc("protected"), F.desc(F.round("rrf", 9)), F.col("dependent") - F.col("support"), "support"]
    first = candidates.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", per, "kind").orderBy(*order)))
    first = first.where((F.col("kind") != "definition") | (F.col("_k") <= definitions))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", per).orderBy(*order))).where(F.col("place") <= total).drop("_k")


def reference_order(columns: list[str]) -> list[Column]:
    """The reference's order of final candidates: alias hit, protection, rerank score and rank, fusion score, distance.
    What a candidate hasn't counts as no alias, not protected, score -1 and last rank; an id is never needed, since
    two candidates of one dependent and kind differ in distance."""
    have = {"alias": F.desc("alias"), "protected": F.desc("protected"), "rerank_score": F.desc(F.coalesce("rerank_score", F.lit(-1.0))), "rerank_rank": F.coalesce("rerank_rank", F.lit(10**9))}
    return [o for c, o in have.items() if c in columns] + [F.desc(F.round("rrf", 9)), F.col("dependent") - F.col("support")]


def final_selection(candidates: DataFrame, logic: int = 20, definitions: int = 10, order: list[Column] | None = None) -> DataFrame:
    """candidates(doc_id, dependent, support, kind, rrf; alias, protected, rerank_score, rerank_rank where known): the best
    definitions up to their limit, and logic candidates up to theirs plus the definitions' unused places, by default in
    reference_order."""
    w = Window.partitionBy("doc_id", "dependent", "kind").orderBy(*(order or reference_order(candidates.columns)))
    placed = candidates.withColumn("place", F.row_number().over(w))
    used = F.least(F.lit(definitions), F.count_if(F.col("kind") == "definition").over(Window.partitionBy("doc_id", "dependent")))
    room = F.when(F.col("kind") == "definition", F.lit(definitions)).otherwise(logic + definitions - used)
    return placed.withColumn("room", room).where(F.col("place") <= F.col("room")).drop("room")


def candidate_id(dependent: Column, support: Column, kind: Column) -> Column:
    """The first 24 hexadecimal digits of the SHA-256 of the three, parted by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", dependent.cast("string"), support.cast("string"), kind), 256), 1, 24)


def distance_bucket(distance: Column) -> Column:
    """1-5, 6-30 or >30."""
    return F.when(distance <= 5, "1-5").when(distance <= 30, "6-30").otherwise(">30")


def evaluation(candidates: DataFrame, gold: DataFrame, far: int = 30) -> DataFrame:
    """candidates(doc_id, dependent, support), gold(doc_id, dependent, support, explicit) -> one row: implicit gold pairs,
    recall, far pairs and their recall (null where there are none), most and average candidates per dependent."""
    keys = candidates.select("doc_id", "dependent", "support").distinct().withColumn("hit", F.lit(1))
    implicit = gold.where(~F.col("explicit")).select("doc_id", "dependent", "support").distinct().join(keys, ["doc_id", "dependent", "support"], "left")
    is_far = F.col("dependent") - F.col("support") > far
    recall = implicit.agg(F.count("*").alias("n_gold"), (F.count("hit") / F.nullif(F.count("*"), F.lit(0))).alias("recall"), F.count_if(is_far).alias("n_far"), (F.count_if(is_far & F.col("hit").isNotNull()) / F.nullif(F.count_if(is_far), F.lit(0))).alias("far_recall"))
    budget = candidates.groupBy("doc_id", "dependent").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("average"))
    return recall.crossJoin(F.broadcast(budget))


def evaluation_by_kind(candidates: DataFrame, gold: DataFrame, far: int = 30) -> DataFrame:
    """candidates(doc_id, dependent, support, kind, channels, selected), gold(doc_id, dependent, support, kind, explicit) ->
    one row: evaluation of the selected, pairs told apart by kind, far ones of logic alone, with the same for each kind,
    most_definitions of a dependent, and by channel all candidates and the selected gold pairs that only it found."""
    key = ["doc_id", "dependent", "support", "kind"]
    chosen = candidates.where("selected")
    implicit = gold.where(~F.col("explicit")).select(*key).distinct().join(chosen.select(*key).distinct().withColumn("hit", F.lit(1)), key, "left")
    held = {"": F.lit(True), "_logic": F.col("kind") == "logic", "_definition": F.col("kind") == "definition", "_far": (F.col("kind") == "logic") & (F.col("dependent") - F.col("support") > far)}
    parts = [a for name, c in held.items() for a in (F.count_if(c).alias(f"n{name or '_gold'}"), F.count_if(c & F.col("hit").isNotNull()).alias(f"hits{name}"))]
    recall = implicit.agg(*parts)
    for name in held:
        recall = recall.withColumn("far_recall" if name == "_far" else f"recall{name}", F.col(f"hits{name}") / F.nullif(F.col(f"n{name or '_gold'}"), F.lit(0)))
    per = chosen.groupBy("doc_id", "dependent").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "definition").alias("d"))
    budget = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_selected"), F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("average"), F.coalesce(F.max("d"), F.lit(0)).alias("most_definitions"))
    alone = chosen.where(F.size("channels") == 1).join(implicit.select(*key), key, "left_semi")
    counted = channel_counts(candidates).withColumnRenamed("counts", "channel_counts").crossJoin(channel_counts(alone).withColumnRenamed("counts", "exclusive_hits"))
    return recall.crossJoin(F.broadcast(budget)).crossJoin(F.broadcast(counted))


def channel_counts(candidates: DataFrame) -> DataFrame:
    """candidates(channels) -> one row: a map of channel to candidates."""
    each = candidates.select(F.explode("channels").alias("channel")).groupBy("channel").agg(F.count("*").alias("n"))
    return each.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "n")))).alias("counts"))


def retrieval_report(candidates: DataFrame) -> DataFrame:
    """candidates(doc_id, dependent, support, kind, channels, selected), those before reranking -> one row: candidates and
    selected ones in all and by kind, by channel and by distance, and the number of dependents."""
    logic, definition = (F.col("kind") == k for k in ("logic", "definition"))
    bucket = distance_bucket(F.col("dependent") - F.col("support"))
    totals = candidates.agg(
        F.count("*").alias("pre_rerank"), F.count_if(logic).alias("logic"), F.count_if(definition).alias("definition"),
        F.count_if("selected").alias("selected"), F.count_if(logic & F.col("selected")).alias("selected_logic"), F.count_if(definition & F.col("selected")).alias("selected_definition"),
        F.create_map(*[x for b in ("1-5", "6-30", ">30") for x in (F.lit(b), F.count_if(bucket == b))]).alias("distance_buckets"),
        F.count_distinct("doc_id", "dependent").alias("n_dependents"),
    )
    return totals.crossJoin(F.broadcast(channel_counts(candidates).withColumnRenamed("counts", "channel_counts")))


def dependent_counts(candidates: DataFrame) -> DataFrame:
    """candidates(doc_id, dependent, selected) -> candidates before reranking and selected ones of each dependent."""
    return candidates.groupBy("doc_id", "dependent").agg(F.count("*").alias("pre_rerank"), F.count_if("selected").alias("selected"))


def accepted(report: DataFrame) -> DataFrame:
    """The report with its verdict: recall of 0.95, far recall of 0.9 where there is one, at most 30 candidates and, where
    the report counts them, 10 definitions."""
    few = F.col("most_definitions") <= 10 if "most_definitions" in report.columns else F.lit(True)
    return report.withColumn("accepted", F.coalesce((F.col("recall") >= 0.95) & F.coalesce(F.col("far_recall") >= 0.9, F.lit(True)) & (F.col("most") <= 30) & few, F.lit(False)))


def coverage(conditions: Column, conclusions: Column, similarity) -> Column:
    """Mean over condition vectors of the best similarity to a conclusion vector; 0 when either side is empty."""
    best = F.transform(conditions, lambda c: F.coalesce(F.array_max(F.transform(conclusions, lambda d: similarity(c, d))), F.lit(0.0)))
    return F.when((F.size(conditions) == 0) | (F.size(conclusions) == 0), 0.0).otherwise(F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(conditions))


def expanded(seeds: DataFrame, explicit: DataFrame, limit: int = 10) -> DataFrame:
    """seeds(doc_id, dependent, support, rank), explicit(doc_id, dependent, support): supports of the seeds' own explicit
    supports, scored 1 / (rank + ln(1 + distance)), the best kept per pair."""
    e = explicit.select("doc_id", F.col("dependent").alias("seed"), F.col("support").alias("far"))
    s = seeds.where("rank <= 5").select("doc_id", "dependent", F.col("support").alias("seed"), "rank")
    got = s.join(e, ["doc_id", "seed"]).where(F.col("far") < F.col("dependent"))
    score = 1 / (F.col("rank") + F.log1p(F.col("dependent") - F.col("far")))
    best = got.groupBy("doc_id", "dependent", F.col("far").alias("support")).agg(F.max(score).alias("score"))
    return ranked(best, limit)


def rerank_tasks(candidates: DataFrame, size: int = 20) -> DataFrame:
    """candidates(doc_id, dependent, support, kind, candidate_id, rrf) -> (doc_id, dependent, kind, batch, ids, fingerprint):
    batches in order of fusion score; the fingerprint, of the ids, is the key under which an answer is kept."""
    w = Window.partitionBy("doc_id", "dependent", "kind").orderBy(F.desc(F.round("rrf", 9)), "support")
    placed = candidates.withColumn("_p", F.row_number().over(w)).withColumn("batch", F.floor((F.col("_p") - 1) / size))
    listed = placed.groupBy("doc_id", "dependent", "kind", "batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "candidate_id"))), lambda x: x["candidate_id"]).alias("ids"))
    return listed.withColumn("fingerprint", F.sha2(F.to_json("ids"), 256))


def reranked(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """candidates with the score and rank of scores(candidate_id, rerank_score); one without a score is an error."""
    missing = F.raise_error(F.concat(F.lit("no score for "), F.col("candidate_id"))).cast("double")
    joined = candidates.join(scores.dropDuplicates(["candidate_id"]), "candidate_id", "left").withColumn("rerank_score", F.coalesce(F.col("rerank_score").cast("double"), missing))
    return joined.withColumn("rerank_rank", F.row_number().over(Window.partitionBy("doc_id", "dependent", "kind").orderBy(F.desc("rerank_score"), F.desc(F.round("rrf", 9)), "support")))


def threshold_coverage(conditions: Column, conclusions: Column, similarity, least: float) -> Column:
    """The share of condition vectors with a conclusion vector whose similarity is over `least`; 0 when either side is empty."""
    hit = F.filter(conditions, lambda c: F.exists(conclusions, lambda d: similarity(c, d) > least))
    return F.when((F.size(conditions) == 0) | (F.size(conclusions) == 0), 0.0).otherwise(F.size(hit) / F.size(conditions))


def embedding_keys(texts: DataFrame, model: str) -> DataFrame:
    """texts(doc_id, text) -> (key, text, first_doc, uses): distinct normal texts (lower case, white space folded) with the
    SHA-256 of model and text, under which a vector is kept; blank texts have none."""
    normal = F.lower(F.trim(F.regexp_replace("text", "(?U)\\s+", " ")))
    rows = texts.select("doc_id", normal.alias("text")).where("text <> ''")
    return rows.groupBy("text").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("uses")).withColumn("key", F.sha2(F.concat(F.lit(model), F.lit("\0"), F.col("text")), 256))


def embedding_misses(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """keys without a valid vector in cache(key, vector): empty ones, ones of zeros and ones with a value that is no finite
    number don't count."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = cache.where((F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0))
    return keys.join(valid.select("key").distinct(), "key", "left_anti")


def shared_symbol_scores(symbols: DataFrame, units: DataFrame) -> DataFrame:
    """symbols(doc_id, unit, symbol), distinct, units(doc_id, unit) -> (doc_id, dependent, support, score) of pairs support <
    dependent of a document: the sum of ln(1 + N / df) over the symbols that both have and that at most max(3, a fifth of the
    document's N units) have. Frequent symbols tell nothing."""
    sizes = units.groupBy("doc_id").agg(F.count("*").alias("n"))
    rare = symbols.groupBy("doc_id", "symbol").agg(F.count("*").alias("df")).join(sizes, "doc_id").where(F.col("df") <= F.greatest(F.lit(3), F.ceil(F.col("n") * 0.2)))
    rows = symbols.join(rare, ["doc_id", "symbol"])
    a, b = rows.select("doc_id", "symbol", "df", "n", F.col("unit").alias("dependent")), rows.select("doc_id", "symbol", F.col("unit").alias("support"))
    return a.join(b, ["doc_id", "symbol"]).where("support < dependent").groupBy("doc_id", "dependent", "support").agg(F.sum(F.log1p(F.col("n") / F.col("df"))).alias("score"))


#: Query vectors that a task holds at once; queries and vectors of one matrix of scores; found rows that wait to be cut to the best.
QUERY_BLOCK = 4096
SCORED, WAITING = (256, 2048), 400_000


def nearest_before(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """vectors(vec_id, embedding), queries alike -> (dependent, support, score): candidates for the k nearest vectors of
    lesser id of each query, by cosine (0 for a zero vector).

    Queries come in blocks of QUERY_BLOCK, sent to all tasks one block after the other; a task multiplies matrices of
    SCORED and keeps k for each query, and all that tie with the k-th within the rounding of a score, of equal scores the k
    of least id, so a block gives at most some k rows per query and task, and holds little more.
    """
    spark = vectors.sparkSession
    numbered = placed(queries.select("vec_id", "embedding"), "_at", F.col("vec_id"))
    out = None
    for lo in range(0, max(1, queries.count()), QUERY_BLOCK):
        rows = numbered.where((F.col("_at") >= lo) & (F.col("_at") < lo + QUERY_BLOCK)).orderBy("_at").toArrow()
        ids = rows["vec_id"].to_numpy()
        block = spark.sparkContext.broadcast((ids, _unit_rows(rows["embedding"], len(ids))))
        part = vectors.select("vec_id", "embedding").mapInArrow(_best_of_block(block, k), "dependent long, support long, score double")
        out = part if out is None else out.unionByName(part)
    return out


def _unit_rows(column, n: int) -> np.ndarray:
    """Vectors of one length as rows of length 1; zero vectors stay zero."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(n, -1) if n else np.empty((0, 0))
    norm = np.sqrt((rows**2).sum(axis=1, keepdims=True))
    return rows / np.where(norm == 0, 1, norm)


def _best_of_block(block, k: int):
    names = ["dependent", "support", "score"]

    def least(x: np.ndarray, s: np.ndarray, score: np.ndarray) -> list[np.ndarray]:
        """The k best of each x, what ties with the k-th, and of equal scores the k of least s."""
        order = np.lexsort((s, -score, x))
        x, s, score = x[order], s[order], score[order]
        at, new = np.arange(len(x)), np.r_[True, x[1:] != x[:-1]]
        start = np.maximum.accumulate(np.where(new, at, 0))
        end = np.r_[np.flatnonzero(new)[1:], len(x)][np.cumsum(new) - 1]
        equal = np.maximum.accumulate(np.where(new | np.r_[True, score[1:] != score[:-1]], at, 0))
        keep = (score >= score[np.minimum(start + k, end) - 1] - 2e-6) & (at - equal < k)
        return [x[keep], s[keep], score[keep]]

    def run(batches):
        ids, q = block.value
        kth = np.full(len(ids), -np.inf)  # what a score of each query must reach
        place = np.argsort(ids, kind="stable")
        found: list[list[np.ndarray]] = []
        waiting = 0

        def best(x: np.ndarray, s: np.ndarray, score: np.ndarray) -> list[np.ndarray]:
            """The best of each query, whose k-th raises what others must reach."""
            x, s, score = least(x, s, score)
            first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, int)
            full = first[np.diff(np.r_[first, len(x)]) >= k]
            at = place[np.searchsorted(ids[place], x[full])]
            kth[at] = np.maximum(kth[at], score[full + k - 1])
            return [x, s, score]

        def cut() -> None:
            nonlocal found, waiting
            found, waiting = [best(*(np.concatenate(c) for c in zip(*found, strict=True)))], 0

        for b in batches:
            if not b.num_rows or not len(ids):
                continue
            v = b.column(0).to_numpy(zero_copy_only=False)
            rows = _unit_rows(pa.chunked_array([b.column(1)]), b.num_rows)
            for i in range(0, len(v), SCORED[1]):
                mine = v[i : i + SCORED[1]]
                for j in range(0, len(ids), SCORED[0]):
                    asked = ids[j : j + SCORED[0]]
                    scores = q[j : j + SCORED[0]] @ rows[i : i + SCORED[1]].T
                    hit = (mine[None, :] < asked[:, None]) & (scores >= kth[j : j + SCORED[0], None] - 2e-6)
                    x, s = np.nonzero(hit)
                    if not len(x):
                        continue
                    some = [asked[x], mine[s], scores[x, s]]
                    if len(x) > 4 * k * len(asked):
                        some = best(*some)
                    found.append(some)
                    waiting += len(some[0])
                    if waiting > WAITING:
                        cut()
        if found:
            cut()
            x, s, score = found[0]
            for i in range(0, len(x), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 100_000]) for c in (x, s, score)], names=names)

    return run
