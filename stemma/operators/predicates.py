"""Predicate entries: keys, compatibility, candidate pairs with scores, groups and the registry.

Entries are (pos, predicate, name, arity, sorts array, template, gloss): one row per use of a predicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemma.functions.text import jaccard
from stemma.operators.graph import components

# The weights of the reasons that two entries may name one predicate.
WEIGHTS = {"semantic_key": 0.45, "name_key": 0.25, "template": 0.2, "gloss": 0.1}


def name_key(name: Column) -> Column:
    """Letters and digits of a CamelCase or any other name, in upper case."""
    return F.upper(F.regexp_replace(F.coalesce(name, F.lit("")), "[^A-Za-z0-9]+", ""))


def snake_key(name: Column) -> Column:
    """CamelCase and blanks as UPPER_SNAKE."""
    parted = F.regexp_replace(F.coalesce(name, F.lit("")), "([a-z0-9])([A-Z])", "$1_$2")
    return F.upper(F.btrim(F.regexp_replace(parted, "[^A-Za-z0-9]+", "_"), F.lit("_")))


def predicate_id(raw: Column) -> Column:
    """An id without temporary marks and duplicate numbers, prefixed with P_."""
    key = F.regexp_replace(F.regexp_replace(snake_key(raw), "^(P_)?TMP_", ""), "_DUP_\\d+$", "")
    return F.when(key.startswith("P_"), key).otherwise(F.concat(F.lit("P_"), key))


def sorts_compatible(a: Column, b: Column, parents: dict[str, list[str]] | None = None) -> Column:
    """Sorts of equal number, each pair equal, either one Entity, or one an ancestor of the other."""
    above = F.create_map(*[x for k, v in (parents or {}).items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if parents else None

    def fits(x: Column, y: Column) -> Column:
        ok = (x == y) | (x == "Entity") | (y == "Entity")
        if above is not None:
            ok = ok | F.array_contains(F.coalesce(F.element_at(above, x), F.array(F.lit(""))), y) | F.array_contains(F.coalesce(F.element_at(above, y), F.array(F.lit(""))), x)
        return ok

    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, fits), lambda z: F.coalesce(z, F.lit(False)))


def candidate_pairs(entries: DataFrame, parents: dict[str, list[str]] | None = None, least_similarity: float = 0.5) -> DataFrame:
    """Pairs (x, y, score) of entries of equal arity and compatible sorts with one more reason in common: an equal key
    or name, or templates or glosses with enough words shared. Pairs are made by joins on keys and on the words of a prefix:
    with words in order of rarity, two lists of n words that reach the least similarity share one of the first
    n - ceil(least * n) + 1, so common words make no pairs and no pair is lost."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9{}]+"), lambda w: w != ""))
    e = entries.select("pos", "arity", "sorts", snake_key(F.col("predicate")).alias("sk"), name_key(F.col("name")).alias("nk"), words("template").alias("tw"), words("gloss").alias("gw"))
    keys = F.array_distinct(F.array(F.concat(F.lit("s:"), "sk"), F.concat(F.lit("n:"), "nk")))
    blocks = e.select("pos", "arity", F.explode(keys).alias("key"))
    for c, tag in (("tw", "t:"), ("gw", "g:")):
        blocks = blocks.unionByName(_prefixes(e.select("pos", "arity", F.col(c).alias("words")), least_similarity).select("pos", "arity", F.concat(F.lit(tag), "word").alias("key")))
    met = blocks.select(F.col("pos").alias("x"), "arity", "key").join(blocks.select(F.col("pos").alias("y"), "arity", "key"), ["arity", "key"]).where("x < y").select("x", "y").distinct()
    a, b = (e.select(F.col("pos").alias(p), *[F.col(c).alias(f"{c}{p}") for c in ("sorts", "sk", "nk", "tw", "gw")]) for p in "xy")
    both = met.join(a, "x").join(b, "y").where(sorts_compatible(F.col("sortsx"), F.col("sortsy"), parents))
    t, g = jaccard(F.col("twx"), F.col("twy")), jaccard(F.col("gwx"), F.col("gwy"))
    same = {"semantic_key": (F.col("skx") == F.col("sky")).cast("double"), "name_key": (F.col("nkx") == F.col("nky")).cast("double"), "template": t, "gloss": g}
    score = sum((w * same[k] for k, w in WEIGHTS.items()), F.lit(0.0))
    reason = (same["semantic_key"] > 0) | (same["name_key"] > 0) | (t >= least_similarity) | (g >= least_similarity)
    return both.where(reason).select("x", "y", F.round(F.least(score, F.lit(1.0)), 4).alias("score"))


def _prefixes(entries: DataFrame, least: float) -> DataFrame:
    """entries(pos, arity, words) -> (pos, arity, word): the rarest words, as many as a pair of similarity `least` must share
    one of."""
    each = entries.select("pos", "arity", F.explode("words").alias("word"))
    known = each.join(each.groupBy("word").agg(F.count("*").alias("df")), "word")
    listed = known.groupBy("pos", "arity").agg(F.array_sort(F.collect_list(F.struct("df", "word"))).alias("w"))
    n = F.size("w")
    return listed.select("pos", "arity", F.explode(F.slice("w", F.lit(1), (n - F.ceil(least * n) + 1).cast("int"))).alias("w")).select("pos", "arity", "w.word")


def candidate_groups(pairs: DataFrame) -> DataFrame:
    """(group, size, most, members): components of the pairs, larger first, then by best score, then by least member."""
    named = components(pairs)
    best = pairs.join(named.select(F.col("id").alias("x"), "component"), "x").groupBy("component").agg(F.max("score").alias("most"))
    groups = named.groupBy("component").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("id")).alias("members")).join(best, "component")
    number = F.row_number().over(Window.orderBy(F.desc("size"), F.desc("most"), "component"))
    return groups.select(number.alias("group"), "size", "most", "members")


def decided_clusters(decisions: DataFrame, groups: DataFrame) -> DataFrame:
    """decisions(group, cluster, members array), groups(group, members) -> (group, cluster, member): unknown members and
    repeats go, clusters of fewer than two dissolve, what no cluster holds stands alone (cluster null)."""
    known = groups.select("group", F.explode("members").alias("member"))
    told = decisions.select("group", "cluster", F.posexplode("members").alias("at", "member")).join(known, ["group", "member"], "left_semi")
    first = F.row_number().over(Window.partitionBy("group", "member").orderBy("cluster", "at"))
    kept = told.withColumn("_n", first).where("_n = 1").withColumn("_k", F.count("*").over(Window.partitionBy("group", "cluster"))).where("_k >= 2")
    return known.join(kept.select("group", "member", "cluster"), ["group", "member"], "left").select("group", "cluster", "member")


def registry(uses: DataFrame) -> DataFrame:
    """uses(cluster, pos, predicate, name, template) -> one row per cluster: the most common name (the first on ties), all
    distinct names and templates, and a key that is unique, with _ALT_nnn behind all but the first of equal keys."""
    counts = uses.groupBy("cluster", "name").agg(F.count("*").alias("n"), F.min("pos").alias("at"))
    best = counts.groupBy("cluster").agg(F.max_by("name", F.struct("n", -F.col("at"))).alias("name"), F.min("at").alias("at"))
    lists = uses.groupBy("cluster").agg(F.sort_array(F.collect_set("name")).alias("names"), F.sort_array(F.collect_set("template")).alias("templates"))
    keyed = best.join(lists, "cluster").withColumn("key", predicate_id(F.col("name")))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("at")) - 1
    return keyed.withColumn("key", F.when(nth == 0, F.col("key")).otherwise(F.format_string("%s_ALT_%03d", "key", nth))).drop("at")


def merged_registry(rows: DataFrame) -> DataFrame:
    """rows(key, arity, sorts, names, templates): entries of equal key, arity and sorts become one, with all their names and
    templates."""
    gather = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return rows.groupBy("key", "arity", "sorts").agg(gather("names"), gather("templates"), F.count("*").alias("merged"))


#: Rows of either side that one unit of pairs holds, and about how many pairs one task makes.
PAIR_ROWS, TASK_PAIRS = 1024, 4_000_000


def word_overlaps(rows: DataFrame, by: list[str], digits: int = 4) -> DataFrame:
    """rows(id, *by, words) -> (x, y, similarity) of every two rows x < y alike in by: the shared of all their distinct words.

    Rows of a group are dealt over blocks; two blocks meet in one unit, so no task holds a group whole, and there are as
    many tasks as the pairs ask for. Lists of words are compared once in a unit, for all ids that bear them."""
    rows = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in ("id", *by)))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum(F.col("_n").cast("double") * F.col("_n") / 2)).first()[0] or 0
    tasks = int(max(rows.sparkSession.sparkContext.defaultParallelism, total // TASK_PAIRS))
    dealt = rows.join(sizes.select(*by, F.ceil(F.col("_n") / PAIR_ROWS).cast("int").alias("_of")), by).withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_of")).cast("int"))
    unit = [*by, "_i", "_j"]
    listed = lambda i, j, words, ids: dealt.select("id", F.col("words").alias(words), *by, i.alias("_i"), j.alias("_j")).repartition(tasks, *unit).groupBy(*unit, words).agg(F.collect_list("id").alias(ids))
    own, last = F.col("_b"), F.col("_of") - 1
    one = listed(own, F.explode(F.sequence(own, last)), "_wx", "_xs")
    two = listed(F.explode(F.sequence(F.lit(0), own)), own, "_wy", "_ys")
    alike = one.join(two, unit).select(F.round(jaccard(F.col("_wx"), F.col("_wy")), digits).alias("similarity"), "_xs", "_ys", (F.col("_i") == F.col("_j")).alias("_same"))
    pairs = alike.select("similarity", "_same", "_ys", F.explode("_xs").alias("_x")).select("similarity", "_same", "_x", F.explode("_ys").alias("_y")).where("(NOT _same AND _x <> _y) OR _x < _y")
    return pairs.select(F.least("_x", "_y").alias("x"), F.greatest("_x", "_y").alias("y"), "similarity")
