"""Checks and decisions around extraction and relations: roles of units, coverage, spans, pair payloads, stage checks, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What makes a text mathematical, the words that name no statement by themselves, default capacities.
MATH_SIGNAL = "[$=<>∀∃∈≤≥→⇒]|\\\\[A-Za-z]+|\\d\\s*[+*/^-]\\s*\\d"
ANCHOR_STOP_WORDS = ("the", "of", "and", "for", "with", "on", "in", "to", "by", "an")
CAPACITY = {"nodes": 100_000, "edges": 300_000, "json_bytes": 64 << 20}


def math_signal(text: Column) -> Column:
    """Whether a text shows mathematics."""
    return F.coalesce(text, F.lit("")).rlike(MATH_SIGNAL)


def capacity_problems(histories: DataFrame, limits: dict[str, int] = CAPACITY) -> DataFrame:
    """histories(id, nodes, edges, json_bytes) -> (id, problem): a row for each limit that one passes."""
    over = F.array_compact(F.array(*[F.when(F.col(c) > n, F.lit(f"{c}_over_limit")) for c, n in limits.items()]))
    return histories.select("id", F.explode(over).alias("problem"))


def missing_candidates(candidates: DataFrame, covered: DataFrame) -> DataFrame:
    """candidates(block, start, identity, ...) that covered(block, start, identity) has neither by block nor by place and
    identity: two anti-joins."""
    by_block = covered.where("block is not null").select("block").distinct()
    by_place = covered.where("start is not null and identity is not null").select("start", "identity").distinct()
    return candidates.join(by_block, "block", "left_anti").join(by_place, ["start", "identity"], "left_anti")


def rule_role(heading: Column, flags: Column, is_first: Column) -> Column:
    """The role of a unit by rules alone: a logical heading starts a block, a section heading is context, a proof supports, a
    first unit starts, all else continues."""
    return F.when(heading == "logical", "block_start").when(heading == "section", "context").when(F.array_contains(flags, "proof_like"), "support").when(is_first, "block_start").otherwise("continuation")


def final_role(heading: Column, model: Column, rule: Column) -> Column:
    """The model's role where it is one of the known, overruled by headings; else the rule's."""
    known = model.isin("block_start", "context", "support", "continuation")
    return F.when(heading == "logical", "block_start").when(heading == "section", "context").when(known, model).otherwise(rule)


def merged_chunks(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """chunks(doc_id, chunk, core_start, core_end), answers(doc_id, chunk, pos, role, evidence array) -> (doc_id, pos, role,
    evidence): each unit from the chunk in whose core it lies, evidence without repeats."""
    core = answers.join(chunks, ["doc_id", "chunk"]).where((F.col("pos") >= F.col("core_start")) & (F.col("pos") < F.col("core_end")))
    return core.select("doc_id", "pos", "role", F.array_distinct("evidence").alias("evidence"))


def chosen_parents(members: DataFrame) -> DataFrame:
    """members(block, node, label, trusted_label, anchored) -> (block, node, how): the one member; else the one whose label is
    the trusted one; else the one whose text anchors; else none, ambiguous."""
    same = F.coalesce(F.col("label") == F.col("trusted_label"), F.lit(False))
    per = members.groupBy("block").agg(
        F.count("*").alias("n"), F.min("node").alias("only"), F.count_if(same).alias("labels"), F.min(F.when(same, F.col("node"))).alias("labelled"),
        F.count_if("anchored").alias("anchors"), F.min(F.when(F.col("anchored"), F.col("node"))).alias("at"),
    )
    how = F.when(F.col("n") == 1, "single").when(F.col("labels") == 1, "label").when(F.col("anchors") == 1, "anchor").otherwise("ambiguous")
    node = F.when(F.col("n") == 1, F.col("only")).when(F.col("labels") == 1, F.col("labelled")).when(F.col("anchors") == 1, F.col("at"))
    return per.select("block", node.alias("node"), how.alias("how"))


def predicate_matches(entries: DataFrame) -> DataFrame:
    """entries(unit, key, sorts) -> (dependent, support, predicates) of units support < dependent with a predicate of one key
    and fitting sorts: as many, each pair equal or with Entity."""
    e = entries.dropDuplicates(["unit", "key", "sorts"])
    a, b = e.select("key", F.col("unit").alias("dependent"), F.col("sorts").alias("x")), e.select("key", F.col("unit").alias("support"), F.col("sorts").alias("y"))
    fits = (F.size("x") == F.size("y")) & F.forall(F.zip_with("x", "y", lambda p, q: F.coalesce((p == q) | (p == "Entity") | (q == "Entity"), F.lit(False))), lambda z: z)
    return a.join(b, "key").where((F.col("support") < F.col("dependent")) & fits).groupBy("dependent", "support").agg(F.array_sort(F.collect_set("key")).alias("predicates"))


def pair_payloads(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs(dependent, support), nodes(pos, label, text) -> (key, pos1, pos2, label1, text1, label2, text2): the support first,
    under the key that answers come back with."""
    a, b = (nodes.select(F.col("pos").alias(c), F.col("label").alias(f"label{n}"), F.col("text").alias(f"text{n}")) for c, n in (("support", 1), ("dependent", 2)))
    rows = pairs.join(a, "support").join(b, "dependent")
    return rows.select(F.concat_ws("-", "support", "dependent").alias("key"), F.col("support").alias("pos1"), F.col("dependent").alias("pos2"), "label1", "text1", "label2", "text2")


def answers_by_key(payloads: DataFrame, answers: DataFrame) -> DataFrame:
    """payloads with the answer of answers(key, answer), whose keys may be of another type: compared as text."""
    return payloads.withColumn("_k", F.col("key").cast("string")).join(answers.select(F.col("key").cast("string").alias("_k"), "answer"), "_k", "left").drop("_k")


def node_spans(nodes: DataFrame, blocks: DataFrame) -> DataFrame:
    """nodes(id, envelope, own, keys array, found), blocks(key, span) -> (id, span, source): the envelope's span, else the
    node's own, else that of the first of its block keys that is known, else where its text was found."""
    each = nodes.select("id", F.posexplode("keys").alias("_i", "key")).join(blocks.select("key", "span"), "key")
    first = each.groupBy("id").agg(F.min_by("span", "_i").alias("_block"))
    rows = nodes.join(first, "id", "left")
    order = {"envelope": "envelope", "node": "own", "block": "_block", "text": "found"}
    source = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(name)) for name, c in order.items()])
    return rows.select("id", F.coalesce(*order.values()).alias("span"), source.alias("source"))


def stage_checks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: edges whose end is unknown, repeated edges, and whether there are no edges at all."""
    ids = nodes.select("id").distinct()
    a, b = ids.select(F.col("id").alias("src"), F.lit(1).alias("_a")), ids.select(F.col("id").alias("dst"), F.lit(1).alias("_b"))
    invalid = edges.join(a, "src", "left").join(b, "dst", "left").agg(F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("invalid"), F.count("*").alias("n"))
    repeated = edges.groupBy("src", "dst").agg((F.count("*") - 1).alias("more")).agg(F.coalesce(F.sum("more"), F.lit(0)).alias("repeated"))
    return invalid.crossJoin(F.broadcast(repeated)).select("invalid", "repeated", (F.col("n") == 0).alias("empty"))


def cache_is_current(pairs: DataFrame, results: DataFrame, version: int) -> DataFrame:
    """One row: whether results(key, version, valid) has exactly the keys of pairs(key), all of this version and valid."""
    both = pairs.select("key", F.lit(1).alias("_p")).join(results, "key", "full")
    return both.agg(F.coalesce(F.every(F.col("_p").isNotNull() & F.coalesce((F.col("version") == version) & F.col("valid"), F.lit(False))), F.lit(True)).alias("current"))


def reading_order(nodes: DataFrame) -> DataFrame:
    """nodes(doc_id, id, blocks array, pos) with `place`: by the first block, those without one last, then by position."""
    first = F.coalesce(F.array_min("blocks"), F.lit(2**31 - 1))
    return nodes.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(first, "pos", "id")))


def rerank_plan(tasks: DataFrame, cache: DataFrame) -> DataFrame:
    """tasks(fingerprint), cache(fingerprint, valid) -> fingerprint, cached: whether a valid answer is kept already."""
    kept = cache.where("valid").select("fingerprint").distinct().withColumn("_hit", F.lit(True))
    return tasks.select("fingerprint").distinct().join(kept, "fingerprint", "left").select("fingerprint", F.coalesce("_hit", F.lit(False)).alias("cached"))


def usable_alias(alias: Column, type_words: tuple[str, ...]) -> Column:
    """Whether an alias may name a statement: a type with a number always, else four characters of ASCII or two of others."""
    a = F.lower(F.regexp_replace(F.coalesce(alias, F.lit("")), "[^0-9A-Za-z\\x{4e00}-\\x{9fff}]+", ""))
    return a.rlike(f"^(?:{'|'.join(type_words)})\\d") | F.when(a.rlike("^[\\x00-\\x7F]*$"), F.length(a) >= 4).otherwise(F.length(a) >= 2)


def anchor_terms(title: Column, most: int = 6) -> Column:
    """LaTeX commands of a title first, then its words of two letters or more that say something, each once."""
    t = F.coalesce(title, F.lit(""))
    tex = F.regexp_extract_all(t, F.lit("\\\\[A-Za-z]+"), F.lit(0))
    words = F.regexp_extract_all(F.regexp_replace(t, "\\\\[A-Za-z]+", " "), F.lit("[A-Za-z]{2,}|[\\x{4e00}-\\x{9fff}]{2,}"), F.lit(0))
    telling = F.filter(words, lambda w: ~F.lower(w).isin(*ANCHOR_STOP_WORDS))
    return F.slice(F.array_distinct(F.concat(tex, telling)), 1, most)


def line_of(source: Column, offset: Column) -> Column:
    """The line, from 1, of a place in a text; null outside of it."""
    before = F.substring(source, 1, offset)
    return F.when((offset >= 0) & (offset <= F.length(source)), F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1)


def is_excerpt(evidence: Column, source: Column) -> Column:
    """Whether evidence is a part of the source, white space folded; blank evidence is none."""
    fold = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+", " "))
    return (fold(evidence) != "") & F.contains(fold(source), fold(evidence))


def merged_macros(sources: DataFrame) -> DataFrame:
    """sources(doc_id, pos, macros map) -> (doc_id, name, body): of macros of one name the last source's, of several at one place the greatest body."""
    each = sources.select("doc_id", "pos", F.explode("macros").alias("name", "body"))
    return each.groupBy("doc_id", "name").agg(F.max_by("body", F.struct("pos", "body")).alias("body"))


def tagged(value: Column) -> Column:
    """A nested value as text that says so, for stores whose properties are flat."""
    return F.concat(F.lit("json:"), F.to_json(value))


def untagged(value: Column, schema: str) -> Column:
    """The nested value of a tagged text; null for any other."""
    return F.when(F.startswith(value, F.lit("json:")), F.from_json(F.substr(value, F.lit(6)), schema))
